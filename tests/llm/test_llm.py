"""Each training-data operator against brute force, round trips or held-out labels, and on awkward rows."""

import base64
import collections
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from palisade.llm import ann, bpe, exact, langid, minhash, packing, preference, quality, suffix, toxicity
from palisade.llm.queries import ORACLES, QUERIES

#: A type for each column that operators use inside, to clash with them.
CLASHES = ("row", "spans", "class_id", "keep_id", "bucket", "kept", "_gone", "_known", "label", "ids", "body")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


LONG = " ".join(words(1, 30_000))
BASE = words(2, 200)
NEAR = [*BASE[:100], "changed", *BASE[101:]]
AWKWARD = [
    (1, None), (2, ""), (3, "  \n "), (4, "two words"), (5, LONG), (6, LONG), (7, " ".join(BASE)), (8, " ".join(NEAR)),
    (9, " ".join(BASE)), (9, " ".join(BASE)), (None, "no id here at all"), (11, "ab" * 900), (12, "ü" * 700 + "x" + "ü" * 700),
    (13, "x" * 399), (14, "!!! ??? 12 34"), (15, "two words"), (16, "Two  Words"),
    (17, " ".join(words(3, 50)) + " ".join(BASE[:120]) + " ".join(words(4, 50))), (18, "𝒳 emoji 🙂 it's 1 2\n\n\tend "),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", None, *("clash",) * len(CLASHES)) for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(awkward, nothing):
    got = exact.exact_groups(awkward).collect()
    groups = collections.defaultdict(list)
    for i, t in AWKWARD:
        groups[t or ""].append(i)
    want = []
    for own in groups.values():
        best = max((i for i in own if i is not None), default=None)
        want += [(i, best, len(own), i == best) for i in own]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact.exact_groups(nothing).count() == 0
    left = exact.drop_exact(awkward)
    assert left.columns == awkward.columns
    assert {r.doc_id for r in left.collect()} == {w[0] for w in want if w[3]}


def test_exact_judges_rows(spark, nothing):
    """Null and repeated ids on different texts: only the repeated text goes."""
    docs = [(None, "A"), (7, "A"), (None, "B"), (3, "C"), (4, "C"), (3, "D"), (3, "E"), (None, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, exact.exact_groups(df).collect()), key=repr)
    want = [(None, 7, 2, False), (7, 7, 2, True), (None, None, 1, True), (3, 4, 2, False), (4, 4, 2, True),
            (3, 3, 1, True), (3, 3, 1, True), (None, 5, 2, False), (5, 5, 2, True)]
    assert got == sorted(want, key=repr)
    left = {tuple(r) for r in exact.drop_exact(df).collect()}
    assert left == {(7, "A"), (None, "B"), (4, "C"), (3, "D"), (3, "E"), (5, "")}


def test_exact_query_on_odd_ids(spark, tmp_path):
    """One row a document and the digest of its own text, as in SQL."""
    docs = [(None, "A"), (7, "A"), (None, "B"), (3, "C"), (4, "C"), (3, "D"), (3, "E"), (8, None)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).toPandas().to_parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM '{folder}/documents.parquet'")
    read = con.execute(ORACLES["op5_exact_dedup"])
    want = sorted((tuple(r) for r in read.fetchall()), key=repr)
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/s/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op5_exact_dedup"](spark, f"{folder}/s").collect()), key=repr)
    assert got == want and len(got) == len(docs)


def shingle_counts(text: str | None) -> collections.Counter:
    w = (text or "").lower().encode().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_classes(docs: list[tuple], counted: bool) -> dict:
    sets = {i: shingle_counts(t) for i, t in docs if i is not None}
    if not counted:
        sets = {i: collections.Counter(set(s)) for i, s in sets.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            inverted[g].add(i)
    for i, s in sets.items():
        for j in set().union(*(inverted[g] for g in s)) if s else ():
            both = s & sets[j]
            if j < i and both.total() / (s | sets[j]).total() >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        element = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
        a, b = rng.choice([0.5, 1, 2.5, 7], 30), rng.choice([0.5, 1, 2.5, 7], 30)
        s = minhash.signatures(np.repeat([0, 1], 30), np.tile(element, 2), np.concatenate([a, b]), 2)
        agree.append(((s[0] == s[1]).mean(), np.minimum(a, b).sum() / np.maximum(a, b).sum()))
    agree = np.array(agree)
    assert abs(agree[:, 0].mean() - agree[:, 1].mean()) < 0.02
    assert np.abs(agree[:, 0] - agree[:, 1]).max() < 0.2


@pytest.mark.parametrize("counted", [False, True])
def test_minhash(awkward, nothing, counted):
    got = minhash.near_groups(awkward, counted=counted).collect()
    assert len(got) == len(AWKWARD)
    want = near_classes(AWKWARD, counted)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    sizes = collections.Counter(want[i] for i, _ in AWKWARD if i is not None)
    assert all(r.class_size == sizes[r.class_id] for r in got if r.doc_id is not None)
    if not counted:
        assert minhash.near_groups(nothing).count() == 0


def test_minhash_crowded_bucket(spark, monkeypatch):
    """Texts that share half their words crowd the buckets; some of them are near copies all the same."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    shared = words(5, 60)
    docs = []
    for k in range(30):
        own = words(100 + k // 3, 25)
        docs.append((k, " ".join([*shared, *own[:24], f"w{k}"])))
    got = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == near_classes(docs, False)


def test_minhash_first_shared_band(spark):
    """Bytes of an earlier band agree by accident, its darts do not: the pair is compared in the band it shares."""
    texts = [(1, " ".join(BASE)), (2, " ".join(NEAR))]
    docs = spark.createDataFrame([(k, t) for k, t in texts], "doc long, text string")
    marks = spark.createDataFrame([(k, bytearray(minhash.COORDINATES), [10 + k, 20, *range(30, 60)]) for k, _ in texts],
                                  "doc long, mark binary, bands array<bigint>")
    members = spark.createDataFrame([(20, 1, 200, 1), (20, 1, 200, 2)], "bucket long, band int, bulk long, doc long")
    linker = minhash.Linker(marks.select("doc"), marks, minhash._sets(docs, 5, False), 0.8)
    linker.across(members)
    assert {tuple(r) for r in linker.classes.collect()} == {(1, 1), (2, 1)}


def test_minhash_judges_texts(spark):
    """Repeated and null ids: near texts are linked whatever their ids, others are not, and one of each class stays."""
    other = " ".join(words(9, 150))
    docs = [(7, " ".join(BASE)), (9, " ".join(NEAR)), (9, other), (None, " ".join(NEAR)), (None, other + " end"), (None, None), (3, ""),
            (2 ** 60 + 1, " ".join(words(11, 80))), (None, " ".join(words(10, 90)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in minhash.near_groups(df).collect())
    big = 2 ** 60 + 1
    assert got == sorted([(7, 7, 3), (9, 7, 3), (0, 7, 3), (9, 9, 2), (0, 9, 2), (0, 0, 1), (3, 3, 1), (big, big, 1), (0, 0, 1)])
    left = {(r.doc_id, r.text) for r in minhash.drop_near(df).collect()}
    assert left == {docs[0], docs[2], docs[5], docs[6], docs[7], docs[8]}


def test_minhash_links_span(spark, monkeypatch):
    """However many pairs a unit compares, fewer links leave it than it has members."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    seen = []
    link = minhash.Linker.link

    def counted(self, found):
        found = minhash.keep(found)
        seen.append(found.count())
        link(self, found)

    monkeypatch.setattr(minhash.Linker, "link", counted)
    shared = words(5, 60)
    docs = [(k, " ".join([*shared, *words(700 + k, 8)])) for k in range(60)]
    docs += [(100 + k, " ".join([*words(6, 40), *words(800 + k, 14)])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_groups(df).collect()} == near_classes(docs, False)
    assert seen[-1] <= 32 * len(docs)


def test_minhash_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op3_minhash"](spark, sf).collect()} == near_classes(docs, False)


def without_repeats(docs: list[tuple], length: int = 400) -> list[tuple]:
    bodies = [(i, (t or "").encode()) for i, t in docs]
    counts = collections.Counter(hash(b[k:k + length]) for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        edges = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if counts[hash(b[k:k + length])] > 1:
                edges[k] += 1
                edges[k + length] -= 1
        gone = np.cumsum(edges[:-1]) > 0
        runs = int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digested(df) -> list[tuple]:
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_suffix(awkward, nothing, spark, sf):
    assert digested(suffix.remove_repeats(awkward)) == without_repeats(AWKWARD)
    assert suffix.remove_repeats(nothing).count() == 0
    left = suffix.drop_repeats(awkward)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD)
    assert {r.text for r in left.where("doc_id in (5, 6)").collect()} == {""}


def test_suffix_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, sf).collect()]
    assert sorted(got, key=repr) == without_repeats(docs)


def test_suffix_across_segments_and_forms(spark, monkeypatch):
    """Small segments; one passage with many surroundings, and in part only."""
    monkeypatch.setattr(suffix, "SEGMENT", 1 << 10)
    passage = " ".join(words(6, 150))
    docs = [(k, " ".join(words(200 + k, 30)) + passage[k * 17:k * 17 + 380 + 12 * k] + " ".join(words(300 + k, 300))) for k in range(12)]
    got = digested(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    want = without_repeats(docs)
    assert got == want and 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_suffix_levels_merge_when_a_batch_meets_them(spark, monkeypatch):
    """Four batches make one array each and merge two; merges that no batch meets took twice the disk."""
    stored, store = [], suffix.SuffixFamily._store
    monkeypatch.setattr(suffix.SuffixFamily, "_store", lambda self, entries: stored.append(1) or store(self, entries))
    passage = " ".join(words(7, 150))
    docs = [(k, " ".join(words(500 + k, 40)) + passage[k:] + " ".join(words(600 + k, 40))) for k in range(12)]
    assert digested(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == without_repeats(docs)
    assert len(stored) == 5


def test_near_comparisons_do_not_share_a_task(spark, monkeypatch):
    """What is compared exactly is read from disk, so that a task needs one Python worker and not two."""
    plans, verify = [], minhash._verify
    monkeypatch.setattr(minhash, "_verify", lambda pairs, *rest: plans.append(
        pairs._jdf.queryExecution().executedPlan().toString()) or verify(pairs, *rest))
    text = words(8, 60)
    docs = [(k, " ".join(text[:-1] + [f"end{k}"])) for k in range(4)]
    found = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0} and plans and not any("MapInPandas" in p for p in plans)


@pytest.mark.parametrize("module", [packing, langid])
def test_workers_give_back_what_arrow_held(spark, monkeypatch, module):
    """After a task's last batch, or when it is stopped before that."""
    import pyarrow as pa
    docs, caught, given = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    monkeypatch.setattr(module, "let_go", lambda: given.append(1), raising=False)
    if module is packing:
        packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    else:
        langid.keep_known(docs, ([], np.zeros((0, langid.WIDTH), np.float32)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    list(caught[0](iter([batch])))
    assert len(given) == 1
    parts = caught[0](iter([batch]))
    next(parts)
    parts.close()
    assert len(given) == 2


def test_passages_of_55_words(spark):
    """The corpus stage takes out whole passages of 55 words, wherever they stand, and nothing else."""
    rng = random.Random(8)
    passages = [" ".join(words(900 + k, 55)) for k in range(6)]
    docs = []
    for k in range(60):
        own = [" ".join(words(1000 + 10 * k + j, 40)) for j in range(3)]
        docs.append((k, f" {passages[rng.randrange(6)]} ".join(own) if k % 2 else " ".join(own)))
    got = {r.doc_id: r.text for r in suffix.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {r[0]: r[4] for r in without_repeats(docs, suffix.PASSAGE)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == want
    for i, t in docs:
        assert not any(p in got[i] for p in passages) and (got[i] == t or i % 2)


def test_ann(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
        x = np.stack(table["embedding"].to_numpy()).astype(float)
        got = QUERIES["op2_ann"](spark, folder).toPandas()
        hits = 0
        for q, own in got.groupby("query_id"):
            score = x @ x[table.index[table["vec_id"] == q][0]]
            score[table["vec_id"] == q] = -9
            order = np.lexsort((table["vec_id"], -score))[:20]
            hits += len(set(table["vec_id"].to_numpy()[order]) & set(own["vec_id"]))
            assert own["rank"].tolist() == list(range(1, 21)) or sorted(own["rank"]) == list(range(1, 21))
        assert hits >= 0.9 * 20 * (table["vec_id"] % 20 == 0).sum()


def test_ann_awkward(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 3.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0]), (40, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, list string")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 3, 6.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(df.where("vec_id = 4"), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_blocks(spark, monkeypatch):
    """Many blocks and lists, one vector very common: the same as brute force when all lists are read."""
    monkeypatch.setattr(ann, "ROWS", 16)
    monkeypatch.setattr(ann, "PER_LIST", 32)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 150, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5, probe=100.0).toPandas()
    for q in range(0, len(x), 10):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -score))[:5]
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == order.tolist()


def packed_whole(rows: pd.DataFrame, docs: list[tuple]) -> None:
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = collections.Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[(i, tuple(ids))] += 1
    known = collections.defaultdict(list)
    for r in rows.itertuples():
        known[None if pd.isna(r.doc_id) else int(r.doc_id)].append(r)
    for (i, ids), n in want.items():
        own = [r for r in known[i] if r.doc_tokens == len(ids)]
        cover = np.zeros(len(ids), int)
        for r in own:
            assert tuple(np.frombuffer(r.ids, "<u4")) == ids[r.start:r.start + r.length]
            cover[r.start:r.start + r.length] += 1
        assert (cover == n).all()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert own["length"].sum() <= 4096


def test_packing(awkward, nothing, spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    packed_whole(packing.pack(awkward, path).toPandas(), AWKWARD)
    assert packing.pack(nothing, path).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, path).toPandas()
    packed_whole(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    sums = rows.groupby("sequence_id")["length"].sum()
    padding = sum(4096 - n for n in sums if n & (n - 1))
    assert padding < 0.01 * sums.sum()


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(4)
    topics = [rng.integers(0, 500, 40), rng.integers(1000, 1500, 40)]
    docs = [(k, rng.choice(topics[k % 2], 60).astype(np.uint16)) for k in range(20)]
    rows = list(packing.pack_shard(docs, np.ones(1 << 16), 60.0, 240))
    full = [r for r in rows if sum(n for _, _, n in r) == 240]
    assert full and sum(len({d % 2 for d, _, _ in r}) == 1 for r in full) >= len(full) - 1


def test_bpe(awkward, nothing, spark, sf):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (awkward.select("doc_id", "text"), docs):
        texts = collections.Counter((r.doc_id, r.text or "") for r in df.collect())
        got = collections.Counter()
        for r in bpe.encode_decode(df, path, public_tokenizers.PATTERN).collect():
            text = bytes(r.decoded).decode()
            assert own.encode_ordinary(text) == np.frombuffer(r.ids, "<u4").tolist() and r.n_tokens == len(r.ids) // 4
            got[(r.doc_id, text)] += 1
        assert got == texts
    assert bpe.encode_decode(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_without_memory(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "some words some other words"
    whole = bpe.Codec(path, public_tokenizers.PATTERN).encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert bpe.Codec(path, public_tokenizers.PATTERN).encode(text) == whole


def test_preference(spark):
    rows = [(1, True, 0, "user", "q"), (1, False, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, False, 1, "assistant", "bad"),
            (1, False, 2, "user", "why"), (1, False, 3, "assistant", None),
            (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (2, False, 0, "user", "same"),
            (3, True, 0, None, "lonely"), (None, True, 0, "user", "x"), (4, None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, a string")
    got = {r.pair_id: r for r in preference.preference_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.prompt == "<|user|>\nq<|end|>\n" and one.n_prompt_turns == 1
    assert one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[s.start:s.end] for s in one.chosen_mask] == ["good<|end|>\n"]
    assert [one.rejected[s.start:s.end] for s in one.rejected_mask] == ["bad<|end|>\n", "<|end|>\n"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("<|user|>\nsame<|end|>\n", "", "")
    assert got[3].prompt == "" and got[3].rejected is None and got[3].chosen == "<|user|>\nlonely<|end|>\n"
    assert preference.preference_pairs(df.where("false")).count() == 0


def test_langid(awkward, nothing, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op8_langid"](spark, sf).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    model = langid.fit_profiles(docs)
    found = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(awkward, model).where("doc_id in (1, 2, 3, 14)").collect()}
    assert found == {(i, "und", 0.0) for i in (1, 2, 3, 14)}
    assert langid.identify(nothing, model).count() == 0 and langid.keep_known(awkward, model).columns == awkward.columns
    none = langid.fit_profiles(nothing)
    assert {r.lang_pred for r in langid.identify(awkward, none).collect()} == {"und"}


def test_langid_judges_rows(spark):
    """An id that is null or repeated says nothing about the other text it is on."""
    model = langid.fit_profiles(spark.createDataFrame([("the cat sat on the mat", "en")], "text string, lang string"))
    docs = [(None, "the cat"), (None, "!!!"), (1, "on the mat"), (1, "12 34"), (2, None)]
    left = langid.keep_known(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert {tuple(r) for r in left} == {(None, "the cat"), (1, "on the mat")}


def auc(y: np.ndarray, p: np.ndarray) -> float:
    rank = pd.Series(p).rank().to_numpy()
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_toxicity_counts_are_exact(spark):
    """Beyond 2^18 distinct n-grams of an order the probabilities equal those of counts in a dictionary."""
    rng = random.Random(7)
    docs = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(120))) for k in range(500)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, label int")
    model = toxicity.count_models(spark.createDataFrame(docs, "doc_id long, text string"), labels, "doc_id", "text")
    plain = [collections.Counter(), collections.Counter()]
    for k, text in docs:
        for w in set(text.split()):
            b = b"\1" + w.encode() + b"\2"
            plain[k % 2].update(b[max(0, i - 6):i] for i in range(2, len(b) + 1))
    assert sum(len(g) == 6 for g in plain[0] | plain[1]) > 1 << 18

    def spread(base):
        """Counts by n-gram, all orders: the longest plainly, shorter ones by the different bytes before them."""
        level = {g: n for g, n in base.items() if len(g) == 6}
        out = dict(level)
        for n in range(5, 0, -1):
            lower = collections.Counter(g[-n:] for g in level)
            lower.update({g: c for g, c in base.items() if len(g) == n})
            level = dict(lower)
            out |= level
        return out

    classes, both = [spread(c) for c in plain], spread(plain[0] + plain[1])
    total, types = {}, {}
    for name, counts in ((0, classes[0]), (1, classes[1]), (2, both)):
        total[name], types[name] = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[name][g[:-1], len(g)] += c
            types[name][g[:-1], len(g)] += 1
    said = [w for _, t in docs[:4] for w in t.split()[:20]] + ["unseen", "zzzzzzzz", "abc"]
    data, offsets, _, _ = toxicity.spelled([" ".join(said)])
    owner, depth, packed = toxicity.grams(data, offsets)
    want = []
    for d, g in zip(depth, packed, strict=True):
        g = int(g).to_bytes(7, "big")[-min(int(d), 6):]
        p = [1 / 256, 1 / 256]
        for n in range(1, len(g) + 1):
            for c in (0, 1):
                name = 2 if n <= 3 else c
                own, t = (both if name == 2 else classes[c]).get(g[-n:], 0), total[name][g[-n:][:-1], n]
                if t:
                    p[c] = max(own - 0.75, 0) / t + 0.75 * types[name][g[-n:][:-1], n] / t * p[c]
        want.append(np.log(p[1] + 1e-12) - np.log(p[0] + 1e-12))
    assert np.allclose(model.log_ratio(depth, packed), want, atol=1e-6)


@pytest.mark.parametrize("name,label,least", [("op9_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.8)])
def test_classifiers(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert got["score"].between(0, 1).all() and auc(held[label].to_numpy(), held["score"].to_numpy()) > least


def test_classifiers_awkward(awkward, nothing, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 1, 1), (7, 0, 0), (8, 1, None), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for own in (labels, labels.where("false")):
            rows = score(awkward, fit(awkward, own)).toPandas()
            assert len(rows) == len(AWKWARD) and rows["score"].between(0, 1).all()
            assert (rows.loc[rows["doc_id"].isin([1, 2, 3]), "score"] == 0).all()
        assert score(nothing, fit(awkward, labels)).count() == 0
        assert score(nothing, fit(nothing, labels)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, sf, name):
    _, _, _, diff = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert not diff, "\n".join(diff)


def test_pipeline(spark, sf, awkward, nothing):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, sf)
    single = stages["exact_dedup"](spark, known, sf)
    texts = known.select("text").distinct().count()
    assert single.count() == texts and single.columns == docs.columns
    rows = [tuple(r) for r in single.select("doc_id", "text").collect()]
    near = stages["near_dedup"](spark, single, sf)
    classes = near_classes(rows, False)
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    cut = stages["suffix_dedup"](spark, near, sf)
    want = dict((w[0], w[4]) for w in without_repeats([tuple(r) for r in near.select("doc_id", "text").collect()]))
    assert {r.doc_id: r.n_chars for r in cut.collect()}.keys() == want.keys() and cut.columns == docs.columns
    packed = stages["packing"](spark, cut, sf).toPandas()
    packed_whole(packed, [tuple(r) for r in cut.select("doc_id", "text").collect()])
    for name, stage in corpus_pipeline.STAGES:
        for odd in (awkward, nothing):
            made = stage(spark, odd, sf)
            made.count()
            assert name == "packing" or made.columns == odd.columns
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_duck_views(sf):
    assert duck(sf).execute("SELECT count(*) FROM documents").fetchone()[0] > 0


def test_words_of_texts_are_numbered_by_arrow():
    """Ids of a column equal the tokenizer's own, whatever its signs, letters and nulls; slices cover it once."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    own, coder = Tokenizer.from_file(path), packing.Encoder(path)
    own.encode_special_tokens = True
    texts = ["A. b, C;\n d: é. x", "", None, "日本 語. abc. D,", "µ. a.  b..  c., d", "x\ty. z", "KK İ. ok", "a. b. c. d. ", "\n\n a.\n", "Straße. ÀÉ; " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    got = [ids for part in packing._together(batch) for ids in coder.encode(part.column("text"), 2).to_pylist()]
    assert got == [np.array(own.encode(t or "", add_special_tokens=False).ids + [2], np.uint16).tobytes() for t in texts[1:]]
    assert coder.encode(pa.array([], pa.string()), 2).to_pylist() == []
    long = pa.RecordBatch.from_arrays([pa.array(["x" * (packing.TOGETHER + 1), None, "y", "z" * packing.TOGETHER])], ["text"])
    assert [len(part) for part in packing._together(long)] == [1, 2, 1]


def test_language_vectors_do_not_outlive_a_task(spark):
    import os
    docs = spark.createDataFrame([(k, "the cat sat on the mat", "en") for k in range(8)], "doc_id long, text string, lang string")
    kept = langid.keep_known(docs.coalesce(1), langid.fit_profiles(docs))
    assert kept.count() == 8

    def held(batches):
        import pyarrow as pa
        from palisade.llm import langid
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([langid.ngram_vectors.cache_info().currsize])], ["n"])
    assert {r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()} == {0}


def test_most_telling_ids_are_found_for_many_documents_at_once():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60000, int(n)).astype(np.uint16) % 997 for n in rng.integers(1, 300, 200)] + [np.array([65535], np.uint16)]
    weight = np.round(rng.random(1 << 16), 1)  # many ties
    column = pa.array([None, *[d.tobytes() for d in docs]], pa.binary()).slice(1)
    want = []
    for d in docs:
        ids, tf = np.unique(d, return_counts=True)
        want.append(int(ids[np.argmax(tf * weight[ids])]))
    assert packing.most_telling(column, weight).tolist() == want
    doc, ids, tf = packing._occurrences(column)
    assert [(ids[doc == k].tolist(), tf[doc == k].tolist()) for k in (0, 200)] == [
        tuple(x.tolist() for x in np.unique(docs[k], return_counts=True)) for k in (0, 200)]
