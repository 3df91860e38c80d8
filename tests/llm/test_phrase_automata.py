"""Removal of repeated phrases against a plain version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewave.llm import phrase_automata as P
from codewave.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k int, th string, first int, n string"


def brute(rows):
    """Rows that repeat an id and its text are one document; of one id, texts by their hash."""
    texts = sorted({(i is not None, i or 0, th, text or "") for i, text, th in rows})
    words = {t: re.findall(r"[^\x20\x09-\x0d]+", t[3]) for t in texts}
    seen, result = set(), {}
    for t in texts:
        w, cover = words[t], set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                cover.update(range(s, s + 20))
            seen.add(window)
        kept = [x for i, x in enumerate(w) if i not in cover]
        result[t] = (len(w), len(cover), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    keys = [(i is not None, i or 0, th, text or "") for i, text, th in rows]
    return sorted([(k[1] if k[0] else None, *result[k]) for k in keys], key=repr)


def check(spark, df):
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    wanted = brute([tuple(r) for r in hashed.collect()])
    found = P.remove_phrases(df)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    return wanted


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = check(spark, table)
    assert sum(r[2] for r in wanted) > 0
    assert queries.QUERIES["op11_phrase_automata"](spark, SF).count() == len(wanted)


def awkward():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgñé日") for _ in range(random.randint(1, 6)))
    fresh = lambda n: [word() for _ in range(n)]
    passage, short, pattern = fresh(60), fresh(19), fresh(7)
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " ".join(short), " ".join(short), " ".join(passage), " ".join(passage)]
    for _ in range(40):  # the passage within different texts
        texts.append(" ".join(fresh(random.randint(0, 30)) + passage + fresh(random.randint(0, 30))))
    for cut in (19, 20, 21, 35):
        texts.append(" ".join(fresh(9) + passage[60 - cut :] + fresh(9)))
    texts.append("\n".join(pattern * 30))  # a text that repeats itself
    texts.append("a " * 300)
    texts.append(" x y " * 25)  # blanks of other alphabets are letters here
    texts.append("z" * 20_000 + " " + " ".join(passage) + "  \t " + " ".join(passage[:25]))
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[8], rows[9], (rows[8][0], "the same id " + rows[9][1]), (None, rows[10][1]), (None, " ".join(passage[5:50]))]
    return rows


@pytest.mark.parametrize("kinds, batch", [(1024, 4096), (3, 2)])
def test_awkward_rows(spark, monkeypatch, kinds, batch):
    monkeypatch.setattr(P, "KINDS", kinds)  # crowded anchors go the other way
    monkeypatch.setattr(P, "BATCH", batch)
    rows = [(*r, 1, "t", 2, "n") for r in awkward()]
    check(spark, spark.createDataFrame(rows, SCHEMA))


def test_parts_of_long_texts(spark, monkeypatch):
    words = P.word_hashes(np.frombuffer(" ".join(awkward()[-2][1].split() * 9).encode(), np.uint8))
    every = P.intervals(words)
    monkeypatch.setattr(P, "PART", 64)
    text = " ".join(awkward()[-2][1].split() * 9).encode()
    assert (P.word_hashes(np.frombuffer(text, np.uint8)) == words).all()
    parts = P.intervals(words)
    windows = lambda rows: Counter((a, f + i) for a, f, n in rows.tolist() for i in range(n))
    assert windows(parts) == windows(every) and set(windows(every).values()) == {1}
    assert len(windows(every)) == len(words) - 19


def test_no_rows(spark):
    assert P.remove_phrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_of_one_letter(spark):
    rows = [(1, "a " * 400_000), (2, "ab cd " * 100_000)]
    got = {r["doc_id"]: r for r in P.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The first window stays, and of the second text the first two.
    assert (got[1]["n_removed"], got[2]["n_removed"]) == (400_000 - 1, 200_000 - 2)


def test_phrases_of_a_shard():
    text, other = tuple(range(30)), (*range(25), 99)
    phrases = P.recurring_phrases([text, other], [1, 1], [(1, 0, 0), (2, 0, 7)])
    assert phrases == {text[s : s + 20]: (1, 0, s) for s in range(6)}
    found = list(P.locate([text, other], phrases))
    assert found == [[(s, 1, (1, 0, s)) for s in range(6)]] * 2
    assert P._runs(found[0]) == [[0, 6, 1, 0, 0]]
    assert P._runs([(0, 1, (1, 0, 4)), (1, 1, (1, 0, 9)), (3, 1, (1, 0, 11))]) == [
        [0, 1, 1, 0, 4], [1, 1, 1, 0, 9], [3, 1, 1, 0, 11]
    ]
    alone = P.recurring_phrases([text], [2], [(1, 0, 5)])
    assert alone == {text: (1, 0, 5)} and P.recurring_phrases([text], [1], [(1, 0, 5)]) == {}
    assert list(P.locate([text], alone)) == [[(0, 11, (1, 0, 5))]]
