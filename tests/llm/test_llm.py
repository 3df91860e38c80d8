"""The training-data operators against brute force, on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codewave.llm import (
    bpe,
    exact_dedup,
    langid,
    minhash,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    suffix_dedup,
)
from codewave.llm import queries as Q
from codewave.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, fp bigint, k int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box in the yard "


def awkward():
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 997} {PROSE}" for i in range(400))
    texts = [None, "", " \t\n", "a", "one two", PROSE, PROSE.upper(), PROSE, long, long + " tail", "ñandú Ünïcode 日本 <|endoftext|> x"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, PROSE, "en", "s1", 5), (77, long, None, None, None)]
    return [(*r, "clash", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(text):
    data = text if isinstance(text, bytes) else text.encode()
    return hashlib.sha256(data).hexdigest()


def run(name, spark):
    return [tuple(r) for r in Q.QUERIES[name](spark, SF).collect()]


def test_queries_of_all_operators():
    assert {re.match(r"op(\d+)_", n)[1] for n in Q.QUERIES} == {str(i) for i in range(1, 14)}
    assert set(Q.ORACLES) <= set(Q.QUERIES)


# 1 ---------------------------------------------------------------------------------------


def bpe_rows(rows):
    tokenizer = Tokenizer.from_str(Q.word_bpe())
    out = []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    return sorted(out, key=str)


def test_bpe_is_the_library(spark, docs, empty, real):
    assert sorted(run("op1_bpe", spark), key=str) == bpe_rows(real)
    got = sorted(map(tuple, bpe.encode_decode(docs, Q.word_bpe()).collect()), key=str)
    assert got == bpe_rows([r[:2] for r in awkward()])
    assert bpe.encode_decode(empty, Q.word_bpe()).count() == 0


def test_bpe_blocks_do_not_matter(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_DOCS", 2)
    got = sorted(map(tuple, bpe.encode_decode(docs, Q.word_bpe()).collect()), key=str)
    assert got == bpe_rows([r[:2] for r in awkward()])


# 2 ---------------------------------------------------------------------------------------


def test_langid_on_held_out_documents(spark):
    truth = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = run("op2_ppm_langid", spark)
    assert len(rows) == len(truth) and all(0 <= r[3] <= 1 for r in rows)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r[1]]
    assert sum(truth[r[0]] == r[2] for r in held) >= 0.97 * len(held)


def test_langid_distributions_and_edges(spark, docs, empty):
    rows = [(i, lang, t * 3) for i, (lang, t) in enumerate([("en", PROSE), ("es", "el zorro marrón salta sobre el perro ")] * 5)]
    model = langid.learn(spark.createDataFrame(rows, "id bigint, lang string, text string"))
    bits = langid.Trees(model).bits.astype(np.float64).reshape(-1, 256, 2)
    assert np.allclose(np.exp2(-bits).sum(axis=1), 1, atol=0.02)  # codes are proper
    trees = langid.Trees(model)
    text = langid._bytes(PROSE * 50)
    whole = trees.lengths([text])
    langid_piece, langid.PIECE = langid.PIECE, 97
    try:
        assert np.allclose(whole, trees.lengths([text]), rtol=1e-3)
    finally:
        langid.PIECE = langid_piece
    got = {r[0]: r[1:] for r in langid.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[5][0] == "en"
    assert langid.predict(empty, model).count() == 0
    nothing = langid.learn(spark.createDataFrame([], "id bigint, lang string, text string"))
    assert {r[1] for r in langid.predict(docs, nothing).collect()} == {"und"}


# 3 ---------------------------------------------------------------------------------------


def test_mixing_meets_its_target(spark):
    rows = [(i, "w " * 50, "big" if i % 10 else f"small{i % 30}", "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    got = mixing.mix(table).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    shares = [v / sum(tokens.values()) for v in tokens.values()]
    entropy = -sum(s * math.log(s) for s in shares) / math.log(4)
    repeats = Counter((r["source"], r["row"]["doc_id"]) for r in got)
    assert max(repeats.values()) <= 4 and (abs(entropy - 0.95) < 0.01 or max(repeats.values()) == 4)
    assert abs(sum(tokens.values()) - 150_000) <= 4 * 50
    assert {r["row"]["tokens"] for r in got} == {"x"}


def test_mixing_edges(docs, empty):
    rows = mixing.mix(docs).collect()
    assert rows and mixing.mix(empty).count() == 0
    assert set(rows[0]["row"].asDict()) == set(docs.columns)


# 4 ---------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, close):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if close(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(rows))]


def simhash_rows(rows):
    fps = [(k, brute_fingerprint(t)) for k, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    return sorted([(k, f"{f:016x}", c) for (k, f), c in zip(fps, roots)], key=str)


def test_simhash_is_brute_force(spark, docs, empty, real):
    assert sorted(run("op4_simhash", spark), key=str) == simhash_rows(real)
    got = simhash.near_groups(docs, words_per_shingle=4).collect()
    assert sorted(map(tuple, got), key=str) == simhash_rows([r[:2] for r in awkward()])
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("file_rows", [2048, 20])
def test_crowded_files_lose_no_link(spark, monkeypatch, file_rows):
    monkeypatch.setattr(simhash, "FILE_ROWS", file_rows)
    rng = np.random.default_rng(3)
    values = sorted({int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))) for _ in range(300)})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    named = {r[0] % (1 << 64): r[1] for r in components(simhash.close_links(frame, 4)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[named.get(v, ("alone", v))].add(v)
    want = defaultdict(set)
    for v, c in zip(values, brute_components([(v, v) for v in values], lambda a, b: (a ^ b).bit_count() <= 4)):
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# 5 ---------------------------------------------------------------------------------------


def repeats(rows, size=400):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[s : s + size] for _, t in texts for s in range(len(t) - size + 1))
    out = []
    for key, t in texts:
        mark = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if seen[t[s : s + size]] > 1:
                mark[s : s + size] = b"\1" * size
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((key, len(t), sum(mark), spans, sha(bytes(x for x, m in zip(t, mark) if not m))))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [2048, 2])
def test_repeats_are_brute_force(spark, docs, empty, real, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_INTERVALS", shard)
    assert sorted(run("op5_suffix_dedup", spark), key=str) == repeats(real)
    monkeypatch.setattr(suffix_dedup, "TEXT_PART", 5000)
    suffix_dedup._powers.cache_clear()
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == repeats([r[:2] for r in awkward()])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_order_is_sorted():
    text = np.frombuffer(b"abracadabra" * 60 + b"banana", np.uint8)
    order, _ = suffix_dedup.suffix_order(text)
    data = text.tobytes()
    keys = [data[i : i + 400] for i in order]
    assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


# 6 ---------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    truth = dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect())
    rows = Q.QUERIES["op6_quality_trees"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in rows)
    held = [r for r in rows if r[1] and r[0] in truth]
    assert sum(truth[r[0]] == r[3] for r in held) >= 0.95 * len(held)


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "id bigint, y int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(5, 1), (6, 1), (None, 0), (8, None)], "id bigint, y int")
    assert quality.classify(docs, labels).count() == len(awkward())
    assert quality.classify(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(awkward())


# 7 ---------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


HARD = [
    "a@b.c%d@e.f x.@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 999.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 +1 (843) 555-4223. +12 3 +1+2345678901",
    "ñ😀 me@x.org 😀 +34 912 345 678) 8.8.8.8",
    "a." * 3000 + "@" + "b." * 3000 + " " + "1" * 5000 + " " + "1-" * 4000,
]


def test_base_spans_are_brute_force(spark, docs, empty, real):
    hard = [(i, t) for i, t in enumerate(HARD)]
    frame = spark.createDataFrame(hard, "doc_id bigint, text string")
    for rows, got in [
        (hard, pii.report(frame).collect()),
        ([r[:2] for r in awkward()], pii.report(docs).collect()),
        (real, Q.QUERIES["op7_pii_bootstrap"](spark, SF).collect()),
    ]:
        want = sorted([(k, sha(",".join(base_spans(t)))) for k, t in rows], key=str)
        assert sorted([(r["doc_id"], r["base_sha256"]) for r in got], key=str) == want
    assert pii.report(empty).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"payment card no {4111111111111100 + i} was used" for i in range(2000)]
    seeds = [s for s in seeds if base_spans(s)][:12]
    rows = [*seeds, "payment card no 4111111111111112 was used", "lot 4111111111111112345678 is new", "page 12 of 30"]
    got = pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert not base_spans(rows[12]) and spans[12] == "card:16:32"
    assert spans[13] == spans[14] == ""


def discovered(spark, rows):
    got = pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    return {r["doc_id"]: r["spans"] for r in got}


@pytest.mark.parametrize("unseen", [3, 12])
def test_contexts_cross_shapes(spark, unseen):
    texts = {f"please call +1 (843) 555-{4200 + i} before noon": None for i in range(80)}
    # No seed has this shape; the words around it are those of the seeds.
    texts |= {f"please call 843-555-{4300 + i} before noon": "phone:12:24" for i in range(unseen)}
    # The shape of accepted ones under other words: at 3 of 4 it is below the trust threshold.
    texts["my other line: 843-555-4400 is best"] = "phone:15:27" if unseen > 9 else ""
    texts |= {"shelf 12-345-67890 of room two": "", "page 1234-5678 of the book": ""}  # neither words nor shape
    spans = discovered(spark, list(texts))
    for i, (text, want) in enumerate(texts.items()):
        if want is not None:
            assert not base_spans(text) and spans[i] == want


# 8 ---------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_minhash_estimates_and_edits(spark, real):
    got = {r["doc_id"]: r for r in Q.QUERIES["op8_minhash"](spark, SF).collect()}
    texts = dict(real)
    order = sorted(texts, reverse=True)
    errors = []
    for at, key in enumerate(order):
        text, other = texts[key], texts[order[(at + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert got[key]["edited_sha256"] == sha(edited) and got[key]["n_chars"] == len(text)
        errors.append(got[key]["near_edited"] - jaccard(text, edited))
        assert abs(got[key]["near_next"] - jaccard(text, other)) < 0.15
    assert np.sqrt(np.mean(np.square(errors))) < 0.05


def test_minhash_edges(docs, empty):
    rows = minhash.fingerprint_edits(docs).collect()
    assert len(rows) == len(awkward()) and minhash.fingerprint_edits(empty).count() == 0
    by_text = defaultdict(set)
    texts = {r[0]: r[1] for r in awkward()}
    for r in rows:
        by_text[texts[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}


# 9 ---------------------------------------------------------------------------------------


def test_exact_groups_on_awkward_rows(docs, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS_PER_TASK", 2)
    groups = defaultdict(list)
    for r in awkward():
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(awkward())
    want = Counter((i, keep[t], len(ids), sha(t)) for t, ids in groups.items() for i in ids)
    assert Counter((r[0], r[1], r[2], r[4]) for r in rows) == want
    assert Counter(r[1] for r in rows if r[3]) == Counter(keep.values())
    kept = exact_dedup.drop_exact_copies(docs, largest=False)
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_exact_copies(empty).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups_survive_a_hash_collision(spark, monkeypatch, largest):
    """Texts with one hash and different bytes, whichever of them has the smaller digest."""
    monkeypatch.setattr(exact_dedup, "_content_hash", lambda t: F.substring(t, 1, 3))
    rows = [(i, t) for i, t in enumerate(["abc one", "abc two", "abc one", "abc two", "abc three", "xyz", "xyz"])]
    groups = defaultdict(list)
    for key, text in rows:
        groups[text].append(key)
    best = max if largest else min
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r[0], r[1], r[2], r[4]) for r in exact_dedup.exact_groups(frame, largest=largest).collect()}
    assert got == {(i, best(ids), len(ids), sha(t)) for t, ids in groups.items() for i in ids}
    stay = exact_dedup.drop_exact_copies(frame, largest=largest).collect()
    assert sorted(map(tuple, stay)) == sorted((best(ids), t) for t, ids in groups.items())


# 10 --------------------------------------------------------------------------------------


def hilbert_points(bits):
    return [(x, y) for x in range(1 << bits) for y in range(1 << bits)]


def test_hilbert_curve_is_continuous(spark):
    frame = spark.createDataFrame(hilbert_points(4), "x int, y int")
    frame = frame.select("x", "y", sharding.hilbert_index([frame["x"], frame["y"]], 4).alias("h"))
    path = [(r["x"], r["y"]) for r in sorted(frame.collect(), key=lambda r: r["h"])]
    assert sorted(r["h"] for r in frame.collect()) == list(range(256))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))


def test_shards_are_even_and_gapless(spark, docs, empty, real):
    rows = Q.QUERIES["op10_hilbert_sharding"](spark, SF).collect()
    texts = dict(real)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    for got in (rows, sharding.hilbert_shards(docs).collect()):
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) == set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.hilbert_shards(empty).count() == 0


# pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, empty):
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and (table is docs or out.count() == 0)
    tokens = corpus_pipeline.encode(spark, docs, SF).collect()
    assert len(tokens) == len(awkward()) and all(len(r["ids"]) == r["n_tokens"] for r in tokens)
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, key = [], 0
    for _ in range(40):
        words = rng.choice(vocabulary, 400).tolist()
        rows.append((key, " ".join(words)))
        words[int(rng.integers(400))] = "changed"
        rows.append((key + 1, " ".join(words)))
        key += 2
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r[0] for r in kept} == set(range(0, 80, 2))


def test_near_copies_are_rows_not_ids(spark):
    long = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(1, long), (2, long + " end"), (2, other), (3, other + " end"), (None, long), (4, None), (5, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted(
        [(False, 1, long), (False, 2, other), (True, 0, long), (False, 4, "")]
    )


def test_mixing_texts_under_one_id_alike_in_any_partitioning(spark):
    rows = [(i % 40, f"{'word ' * (i % 17 + 1)}{i}", f"s{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = [
        sorted(map(repr, mixing.mix(df.repartition(n, "text"), budget=20_000).select("row.text", "pass", "block_order").collect()))
        for n in (2, 7)
    ]
    assert drawn[0] == drawn[1] and drawn[0]


def test_written_shards_hold_every_row_in_the_order_of_the_slots(spark, tmp_path):
    rows = [(i % 30 if i % 9 else None, f"text {i % 50} " * (i % 5 + 1), "en", f"s{i % 3}", i % 2, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int, _id string")
    folder = sharding.write_shards(df, str(tmp_path / "out"), 4)
    assert folder == "_shard"
    read = spark.read.parquet(str(tmp_path / "out"))
    plain = lambda d: sorted(map(repr, d.select(df.columns).collect()))
    assert plain(read) == plain(df)
    place = {}
    for r in sharding.hilbert_shards(df, 4).collect():
        place.setdefault((r["shard"], r["doc_id"], r["text_crc32"]), []).append(r["slot"])
    for shard in range(4):
        files = sorted((tmp_path / "out" / f"_shard={shard}").glob("*.parquet"))
        ids = [(r["doc_id"], zlib.crc32(r["text"].encode())) for f in files for r in spark.read.parquet(str(f)).collect()]
        assert len(ids) == 50
        slots = [place[shard, *key].pop(0) for key in ids]
        assert slots == list(range(50))


def test_hilbert_slots_follow_the_documented_order(spark):
    """Curve, high bits of the checksum, part of the id, checksum, id: a plain sort."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(20)).union(docs.withColumn("doc_id", F.lit(None).cast("bigint")).limit(5))
    placed = sharding.hilbert_shards(docs, 4)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SPREAD)).alias("part")
    rows = placed.select("*", part).collect()
    key = lambda r: (
        r["curve_index"], r["text_crc32"] >> (32 - sharding.BITS_HIGH), r["part"],
        r["text_crc32"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"],
    )
    by_place = [key(r) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert by_place == sorted(map(key, rows)) and len(rows) == docs.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
