"""Collocations, spelling variants and WARC archives against brute force, and on awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from palisade.llm import collocation, spelling, warc
from palisade.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "phrase string, word string, n long, part int, bundle string, value string, _id string"


def phrases(docs: list[tuple], least: int, top: int = 2000) -> list[tuple]:
    """All the operator returns, by counting in dictionaries."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    known = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    gone = {(lang, p[a:b]) for (lang, p), v in known.items() for a in range(len(p)) for b in range(a + 2, len(p) + 1)
            if b - a < len(p) and 100 * v >= 80 * known[lang, p[a:b]]}
    by = collections.defaultdict(list)
    for (lang, p), a in known.items():
        if (lang, p) not in gone:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -score) for lang, own in by.items()
                  for rank, (score, a, p, x, y) in enumerate(sorted(own)[:top], 1))


def test_collocations(spark):
    rng = random.Random(3)
    common = ["The", "of", "ärger", "x" * 300, "naïve", " odd", "b"]
    docs = [(rng.choice(["en", "de", None]), "".join(rng.choice(common) + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " "])
                                                      for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    docs += [("en", None), ("en", ""), (None, "new york city hall " * 40), ("en", "one"), ("fr", "the the the the the"), ("en", " .,\t ")]
    docs += [("en", docs[5][1])] * 3
    df = spark.createDataFrame([(*d, *[None] * 7) for d in docs], "lang string, text string, " + CLASH).repartition(3)
    got = sorted(map(tuple, collocation.collocations(df, least=5).collect()))
    assert got == phrases(docs, 5) and len(got) > 50
    cut = sorted(map(tuple, collocation.collocations(df, least=5, top=7).collect()))
    assert cut == phrases(docs, 5, 7)
    assert collocation.collocations(df.where("false")).count() == 0
    assert collocation.collocations(df.where("text is null or text = ''")).count() == 0


def test_collocations_small_sieve_and_hot_words(spark, monkeypatch):
    """A sieve that lets nearly all pass and stripes that are all split give the same rows."""
    monkeypatch.setattr(collocation, "SIEVE", 6)
    rng = random.Random(4)
    docs = [("en", " ".join(rng.choice("a b c d e f".split()) for _ in range(400))) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    hot = collocation._hot_hashes(df.sparkSession.createDataFrame([("en", w) for w in "abcdef"], "lang string, phrase string"))
    monkeypatch.setattr(collocation, "_hot_hashes", lambda _: hot)
    assert sorted(map(tuple, collocation.collocations(df, least=8).collect())) == phrases(docs, 8)


def test_collocations_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_collocations"](spark, sf).collect())) == phrases(docs, 30)


def variants(docs: list[tuple]) -> list[tuple]:
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 6
    n = {w: k for w, k in n.items() if k >= 5}
    wild, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            wild[w[:i] + "*" + w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for w in n:
        near[w] = near[w].union(*(wild[w[:i] + "*" + w[i + 1:]] for i in range(len(w)))) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def spelled_docs(seed: int) -> list[tuple]:
    """Words that lose, gain and swap letters, chains of forms among them."""
    rng = random.Random(seed)
    letters = "abcde" + "éàß÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "b" * 200]
    said = []
    for w in base:
        times = 6
        for _ in range(4):
            said += [w] * times
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            times = rng.choice([times, times * 5, times * 6])
            if times > 800:
                break
    rng.shuffle(said)
    docs = [(k, rng.choice([" ", "-", "1", "λ"]).join(said[k * 50:k * 50 + 50]).swapcase()) for k in range(len(said) // 50 + 1)]
    return docs + [(None, " ".join(said[:200])), (3, None), (4, ""), (5, "12 λόγος !!"), (6, docs[0][1]), (6, docs[0][1]), (7, "z" * 70_000)]


@pytest.mark.parametrize("block", [1024, 16])
def test_spelling(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = spelled_docs(block)
    df = spark.createDataFrame([(*d, *[None] * 7) for d in docs], "doc_id long, text string, " + CLASH).repartition(3)
    got = sorted(map(tuple, spelling.spelling_variants(df).collect()), key=repr)
    want = variants(docs)
    assert got == want and sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    assert spelling.spelling_variants(df.where("false")).count() == 0
    assert spelling.spelling_variants(df.where("text is null or text = ''")).count() == 0


def test_spelling_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_spelling"](spark, folder).collect()), key=repr) == variants(docs)


def test_crc_of_joined_texts():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 5, 300, 70_000]))) for _ in range(40)]
    got = spelling.crc_after(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32),
                             np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nd: e", "other"), (5, "u", None), (6, "u", ""),
         (6, "u", ""), (None, "n1", "same"), (None, "n2", "lonely"), (None, "n3", "twice"), (None, "n3", "twice"),
         (9, "long", "é\r\n\r\nWARC/1.1\r\n" * 40_000), (10, "x" * 70_000, "far"), (11, "y", "𝒳 <p>")]


def records(pages: list[tuple], least: int = 0) -> list[tuple]:
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in pages:
        raw, target = (h or "").encode(), last[h or ""]
        again = target >= 0 and i != target and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, *[None] * 7) for p in PAGES], "page_id long, url string, html string, " + CLASH).repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(pages, least):
    assert sorted(map(tuple, warc.archived(pages, least).collect()), key=repr) == records(PAGES, least)


def test_warc_empty(pages):
    assert warc.archived(pages.where("false")).count() == 0


def test_warc_bundles(spark, pages, tmp_path):
    """Small frames and bundles: any Zstandard reader reads them, the index finds each record, payloads come back whole."""
    folder = f"{tmp_path}/archive"
    warc.write_archives(pages, folder, frame=500, bundle=300)
    files = list((tmp_path / "archive").glob("bundle=*/*.txt"))
    assert len(files) > 3
    index = warc.read_index(spark, folder).toPandas()
    assert len(index) == len(PAGES)
    for f in files:
        raw = f.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        frames = warc.seek_table(raw)
        assert whole == b"".join(warc.frame_bytes(raw, a, n) for a, n, _ in frames)
        for r in index[index["bundle"] == f.parent.name.removeprefix("bundle=")].itertuples():
            frame = warc.frame_bytes(raw, r.frame_start, r.frame_bytes)
            head, _, end = warc.read_record(frame, r.place)
            assert head["warc-record-id"] == f"<{r.record_id}>" and end - r.place == r.size
    got = {r.record_id: r for r in warc.read_archives(spark, folder).collect()}
    for i, _, h in PAGES:
        if i in (3, 4, 9, 10, 11):
            assert bytes(got[f"urn:page:{i}"].payload).decode() == h
    wanted = spark.createDataFrame([("urn:page:9",), ("urn:page:1",), ("urn:page:77",)], "record_id string")
    found = {r.record_id: r for r in warc.fetch(spark, folder, wanted).collect()}
    assert set(found) == {"urn:page:9", "urn:page:1"} and bytes(found["urn:page:9"].payload).decode() == PAGES[11][2]
    assert found["urn:page:1"].record_type == "revisit" and found["urn:page:1"].refers_to == "urn:page:3"


def test_warc_damage(spark, pages, tmp_path):
    folder = tmp_path / "archive"
    warc.write_archives(pages.where("page_id = 11"), str(folder))
    path = next(folder.glob("bundle=*/*.txt"))
    path.write_bytes(path.read_bytes()[:-1])
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not a seekable bundle"):
        warc.read_archives(spark, str(folder)).count()


def test_warc_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op11_warc"](spark, sf).where(F.col("page_id").isNotNull()).collect()), key=repr) == records(pages)
