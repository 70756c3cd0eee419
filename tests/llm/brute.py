"""Plain versions of the operators, and awkward documents to hold them against."""

import hashlib
import re
from collections import Counter

import duckdb
from pyspark.sql import Row

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that operators use inside; a table may have them too.
CLASHING = ("gid", "rep", "value", "label", "rest", "length", "kept", "_salt", "bucket", "item_id", "n_words")


def documents() -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY 1").fetchall()


def awkward() -> list[tuple]:
    """(doc_id, text): missing, empty, blank, tiny, very long, tied and repeated texts; each doc_id once."""
    passage = " ".join(f"word{k}" for k in range(90))
    shout = "AN! <b> 100% #*$%&|<> \t tab\x0b\x0cform\r\nline\n\nline\n"
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "One", "two words", "a b c", "A B C", passage, passage.upper(), passage,
        "x " + passage, passage + " y", passage.replace("word45", "else"), "aaaa" * 300, "ab" * 700, "ab " * 900,
        shout, shout * 20, "café naïve 中文 \U0001f600 é   İIΣς", "<|endoftext|> in <|endoftext|>", "<|startoftext|>it's",
        "  two  blanks \n  and lines ", "12345 67890 1,2.3;4", passage + "\n" + passage, ("long " * 3 + passage + " ") * 60,
    ]
    return list(enumerate(texts))


def frame(spark, rows):
    """The rows as documents with further columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None if t is None else "en", "src0", len(t or ""), *CLASHING) for i, t in rows], schema)


def rows_by_id(df) -> dict[int, Row]:
    found = df.collect()
    assert len({r["doc_id"] for r in found}) == len(found)
    return {r["doc_id"]: r for r in found}


def words(text) -> list[str]:
    return WORD.findall(text or "")


def shingles(text, width: int) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_components(rows, width: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    lists: dict = {}
    for i, own in sorted(sets.items()):
        shared = Counter(j for s in own for j in lists.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for s in own:
            lists.setdefault(s, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def word_repeats(rows, width: int) -> dict[int, tuple]:
    """doc_id -> (words, removed words, kept text)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def byte_repeats(rows, width: int) -> dict[int, tuple]:
    """doc_id -> (bytes, removed bytes, removed runs, sha256 of the rest)."""
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + width] for b in raw.values() for k in range(len(b) - width + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def item_matches(rows, items, width: int = 5, least: float = 0.8) -> dict[tuple, tuple]:
    """(doc_id, item_id) -> (first word, words, similarity) of the best window."""
    out = {}
    for item, text in items:
        b = words((text or "").translate(LOWER))
        n, m = len(b), min(width, len(b))
        if not n:
            continue
        own = Counter(tuple(b[k : k + m]) for k in range(n - m + 1))
        for i, t in rows:
            w = words((t or "").translate(LOWER))
            grams = [tuple(w[k : k + m]) for k in range(len(w) - m + 1)]
            if own.keys().isdisjoint(grams):
                continue
            for k in range(len(w) - n + 1):
                c = Counter(grams[k : k + n - m + 1])
                like = sum((c & own).values()) / sum((c | own).values())
                if like >= least and like > out.get((i, item), (0, 0, 0))[2]:
                    out[i, item] = (k, n, like)
    return out
