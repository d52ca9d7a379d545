"""sidelines: season-to-date sports analytics as Spark DataFrame operators.

Subpackages
-----------
sources    readers and sinks (parquet, CSV variants, literal tables)
functions  Column-level helpers (NULL algebra, text, domain rubrics)
operators  DataFrame -> DataFrame verbs (aggregates, windows, joins, reshape)
ml         feature recipes, models, metrics, stacking, tuning
plans      end-to-end jobs composed from the operators, plus the query catalogue
streaming  incremental (micro-batch) variants of the stateless plans
"""

from sidelines.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

__version__ = "0.1.0"
