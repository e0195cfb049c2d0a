"""Small tables and plain versions of the operators."""

import binascii
import re
from itertools import combinations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, lang=None, source=None):
    rows = [(i, t, lang(i) if lang else None, source(i) if source else None, None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def saved(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def crc(x):
    return binascii.crc32(str(x).encode())


def words(text):
    body = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[^\x20\x09-\x0d]+", body)


def ngrams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows, n, num, den):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: ngrams(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}
