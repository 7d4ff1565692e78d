"""Brute-force helpers."""

import hashlib
import re


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text, n=5):
    """Brute force: set of word n-grams of a text, of all its words when it has fewer."""
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
