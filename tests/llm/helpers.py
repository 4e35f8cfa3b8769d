"""Inputs and plain counterparts for the tests of this folder."""

import random
import re

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table from ``(doc_id, text)``; other columns are partly null."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCUMENT)


def clashing(table):
    """The same rows with further columns whose names the operators use themselves."""
    out = table
    for name in ("key", "label", "kept", "tag", "salt", "digest", "rank", "shard", "runs", "mark", "toxic", "score", "row", "n"):
        out = out.selectExpr("*", f"'x' AS {name}")
    return out


def texts(seed, n, vocabulary=30, longest=60):
    """Random texts with copies, changed copies, shared passages, empty and null ones."""
    draw = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(vocabulary)]
    passage = [draw.choice(words) for _ in range(20)]
    out = [(0, None), (1, ""), (2, " \n\t ")]
    for k in range(3, n):
        kind = draw.random()
        body = [draw.choice(words) for _ in range(draw.randint(0, longest))]
        if out[-1][1] and kind < 0.25:
            body = draw.choice([t for _, t in out if t]).split()
            if kind < 0.15 and body:
                body[draw.randrange(len(body))] = "changed"
        elif kind < 0.4:
            body[len(body) // 2 : len(body) // 2] = passage
        out.append((k, draw.choice([" ", "\n", "  "]).join(body)))
    return out


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
