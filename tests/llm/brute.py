"""Definitions that several brute-force tests share."""
import re


def az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", az(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
