"""The training-data operators against brute force, round trips and held-out accuracy."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import fingerprint, linededup, media, mixing, packing, quality, sharding, simhash, toxicity, warc
from factweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, digest string"
LONG = "lorem ipsum dolor " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [(1, None, None, None), (2, "", "en", "b"), (3, LONG, "en", "a"), (4, "x\ny\nz", "en", "a"), (5, "x\ny\nz", "en", "a"), (5, "x\ny\nz", "en", "a"), (6, "x\ny\nz\nw", None, "a"), (7, " \t\n", "en", "b"), (8, "one", "en", None)]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "l", "d") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def empty(df):
    return df.where(F.lit(False))


def test_packing(odd, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for df in (odd, documents):
        pieces = packing.pack_documents(df, path, group_pieces=150).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts}
        wanted = sorted((i, k, s, len(ids[i][s : s + 2048]), zlib.crc32(np.array(ids[i][s : s + 2048], "<u4").tobytes())) for i, _ in texts for k, s in enumerate(range(0, len(ids[i]), 2048)))
        assert sorted(tuple(r)[:5] for r in pieces) == wanted
        for s in {r["sequence_id"] for r in pieces}:
            own = sorted((r["offset"], r["length"]) for r in pieces if r["sequence_id"] == s)
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len({r["sequence_id"] for r in pieces}) <= 1.1 * sum(r["length"] for r in pieces) / 2048 + 4
    assert packing.pack_documents(empty(odd), path).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 200)
    bins, places = packing.sum_of_squares(lengths, 32)
    fill: list[int] = []
    for s, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        def squares(f):
            gaps = [32 - x for x in f if x < 32]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        tries = [squares([*fill[:i], fill[i] + s, *fill[i + 1 :]]) for i in range(len(fill)) if fill[i] + s <= 32] + [squares([*fill, s])]
        if b == len(fill):
            fill.append(s)
        else:
            fill[b] += s
        assert squares(fill) == min(tries)


def test_sharding(spark, odd, documents):
    for df, limit in ((documents, 50_000), (documents, 40), (odd, 50_000)):
        rows = sharding.shard_by_size(df, 5, limit=limit).collect()
        assert len(rows) == df.count()
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        shard: dict = {}
        for r in rows:
            data = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
            assert shard.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        for k in range(5):
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == [*range(sum(r["shard"] == k for r in rows))]
    assert sharding.shard_by_size(empty(odd)).count() == 0


def brute_force(sizes: list[int], shards: int) -> int:
    """The smallest capacity by trying each."""
    ends = np.cumsum(sizes)

    def feasible(c: int) -> bool:
        at = 0
        for _ in range(shards):
            k = bisect.bisect_right(ends, at + c) - 1
            at = int(ends[k]) if k >= 0 else at
        return at == int(ends[-1])

    c = max(sizes)
    while not feasible(c):
        c += 1
    return c


@pytest.mark.parametrize(("limit", "groups"), [(12, 1500), (12, 4000), (10_000, 400)])
def test_smallest_capacity(spark, limit, groups):
    rng = random.Random(limit)
    sizes = [rng.choice([1, 2, 40, 300]) if groups > 2000 else rng.randrange(1, 40) for _ in range(groups)]
    ends = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame([(f"{i:04}", e) for i, e in enumerate(ends)], "digest string, end long")
    capacity, cuts = sharding.find_cuts(groups, ends[-1], max(sizes), 7, limit)
    assert capacity == brute_force(sizes, 7) and cuts[-1] == ends[-1] and len(cuts) <= 7
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= capacity and set(cuts) <= set(ends)


def test_fingerprints(spark, odd, documents):
    for df in (odd.dropDuplicates(["doc_id"]), documents):
        rows = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
        texts = sorted((r["doc_id"], r["text"] or "") for r in df.collect())
        prints: dict = {}
        for k, (i, t) in enumerate(texts):
            following, h = texts[(k + 1) % len(texts)][1], len(t) // 2
            edited = t[: len(t) - h] + following[:h]
            r = rows[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) // 10 <= 64
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and bool(r["fingerprint"]) == bool(t.split())
    near = [r["near_edited"] for r in rows.values()]
    assert np.mean(near) > 0.1 > np.mean([r["near_next"] for r in rows.values()])
    assert fingerprint.fingerprints(empty(odd)).count() == 0


def test_order_matters(spark):
    a = " ".join(f"w{i}" for i in range(400))
    words = a.split()
    moved, edited = " ".join(words[200:] + words[:200]), " ".join(words[:195] + ["new"] * 10 + words[205:])
    df = spark.createDataFrame([(a, x) for x in (a, moved, edited, "other text entirely")], "a string, b string")
    same, shifted, near, far = (r[0] for r in fingerprint.signatures(fingerprint.signatures(df, "a", "x"), "b", "y").select(fingerprint.likeness(F.col("x"), F.col("y"))).collect())
    assert same == 1 and near > shifted > far == 0


def test_order_matters_in_short_texts(spark):
    """Likeness of moved passages against each pair of k-mers' chance to be least, in order and unordered."""
    rows, wanted = [], []
    for n in (10, 20, 30, 60, 100):
        for k in range(40):
            words = [f"w{n}x{k}x{i}" for i in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
        # n - 2 k-mers are in both, the two texts have one more each; pairs within a half keep their order
        half, rest = n // 2 - 1, n - n // 2 - 1
        wanted.append((n, (half * (half - 1) + rest * (rest - 1)) / (n * (n - 1))))
    likeness = fingerprint.likeness(F.col("x"), F.col("y"))
    made = fingerprint.signatures(fingerprint.signatures(spark.createDataFrame(rows, "n int, a string, b string"), "a", "x"), "b", "y")
    found = {r[0]: r[1:] for r in made.groupBy("n").agg(F.avg(likeness), F.stddev(likeness)).collect()}
    assert all(abs(found[n][0] - p) < 0.04 for n, p in wanted), (found, wanted)
    # 64 independent orderings would scatter by sqrt(p (1 - p) / 64), 0.055 to 0.0625
    assert all(found[n][1] < 0.095 for n, _ in wanted), found


def simhash_of(text, size=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, documents):
    for df in (odd, documents):
        texts = sorted((r["doc_id"], r["text"]) for r in df.collect())
        prints = {i: simhash_of(t) for i, t in texts}
        root = {i: i for i in prints}
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        found = simhash.simhash_groups(df).collect()
        assert sorted((r["doc_id"], r["f0"] & (2**64 - 1), r["component_id"]) for r in found) == sorted((i, prints[i], root[i]) for i, _ in texts)
    assert simhash.simhash_groups(empty(odd)).count() == 0


@pytest.mark.parametrize("block", [simhash.ANCHOR_ROWS, 3])
def test_anchors_find_every_link(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for x in base for _ in range(3)]
    values = [*base, *near]
    nodes = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "id long, f0 long")
    roots = {r["id"]: r["root"] for r in simhash.components(simhash.linked(nodes, ["f0"], ["f0"], simhash.BANDS_64, 4, block)).collect()}
    root = {i: i for i in range(len(values))}
    for i, x in enumerate(values):
        for j, y in enumerate(values):
            if (x ^ y).bit_count() <= 4:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {i: roots.get(i, i) for i in root} == root


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [w if i not in (50, 150, 250) else "edited" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))), (4, None), (5, "")]
    found = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3])
def test_crowded_anchors(monkeypatch, crowded):
    """Dense groups, chains and strangers at one anchor and at many, joined as by all comparisons."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    words = np.concatenate([base[0] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)), base[rng.integers(0, 30, 500)] ^ (np.uint64(15) << rng.integers(0, 60, 500, dtype=np.uint64))])
    words = rng.permutation(words)
    for anchor in (np.zeros(1000, np.int64), np.sort(rng.integers(0, 40, 1000))):
        home = rng.random(1000) < 0.5
        at = np.lexsort((~home, anchor))
        anchor, home = anchor[at], home[at]
        moved, to = simhash.local_edges(anchor, home, [words], 4)
        got = np.arange(1000)
        got[moved] = to
        want = np.arange(1000)
        for i in np.flatnonzero(home):
            for j in np.flatnonzero((anchor == anchor[i]) & (np.bitwise_count(words ^ words[i]) <= 4)):
                if want[i] != want[j]:
                    want[np.isin(want, [want[i], want[j]])] = min(want[i], want[j])
        assert got.tolist() == want.tolist()


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [simhash.BLOCK_SHINGLES, 3000])
def test_near_duplicates_overlap_exactly(spark, odd, block):
    """Against brute force, with texts on both sides of the threshold, in one block a group and in several."""
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(150, 400))]
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16):
            text = list(words)
            for at in rng.sample(range(len(text)), edits):
                text[at] = f"e{rng.randrange(9000)}"
            rows += [" ".join(text)] * (1 + edits % 2)
    made = spark.createDataFrame([*enumerate(rows, 100)], "doc_id long, text string")
    for df in (made, odd, empty(odd)):
        texts = sorted({(r["doc_id"], r["text"]) for r in df.collect()}, key=lambda x: x[0])
        sets = [shingles_of(t) for _, t in texts]
        root = {i: i for i, _ in texts}
        for x, (i, _) in enumerate(texts):
            for y, (j, _) in enumerate(texts[:x]):
                both = len(sets[x] | sets[y])
                if len(sets[x] & sets[y]) >= 0.8 * both and root[i] != root[j]:
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        found = simhash.near_duplicate_groups(df, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == root


@pytest.mark.parametrize("lists", [simhash.LIST_ROWS, 2])
def test_near_duplicates_of_blocks(spark, monkeypatch, lists):
    """Blocks of other words appended, cut, inserted or put in the middle, on both sides of the
    threshold, each pair with words of its own; also where all lists of shingles are cut."""
    monkeypatch.setattr(simhash, "LIST_ROWS", lists)
    rng = random.Random(11)
    rows = []
    for k in range(160):
        n = rng.choice([10, 20, 40, 80, 160, 320])
        words = [f"w{k}x{rng.randrange(5 * n)}" for _ in range(n)]
        extra, at = [f"e{k}x{i}" for i in range(max(1, round(n * rng.uniform(0.05, 0.22))))], rng.randrange(n)
        other = [words + extra, words[: n - len(extra)], extra + words, words[:at] + extra + words[at:]][k % 4]
        rows += [words, other]
    texts = ["so it goes and so on " * 30 + " ".join(w) if i % 16 < 2 else " ".join(w) for i, w in enumerate(rows)]
    sets = [shingles_of(t) for t in texts]
    linked = {i for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert 40 < len(linked) < 150
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert {i for i in range(0, len(sets), 2) if found[i] == found[i + 1]} == linked
    assert all(c in (i, i - 1) for i, c in found.items())


def test_media(spark, odd):
    rows = {r["doc_id"]: r for r in media.text_media(odd).collect()}
    for r in odd.collect():
        text = (r["text"] or "").encode()
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        m = rows[r["doc_id"]]
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.text_media(empty(odd)).count() == 0
    tone = (8000 * np.sin(np.arange(8000) / 8)).astype("<i2")
    block = np.zeros((2, 64), np.uint8)
    block[:, 4:] = 0x77
    files = [media.wave(bytes(range(256)), k, 8000, 8) for k in (media.MULAW, media.ALAW)] + [media.wave(tone.tobytes(), media.PCM, 8000, 16), media.wave(block.tobytes(), media.ADPCM, 8000, 4, 64, 121), b"junk", None]
    out = media.to_pcm(spark.createDataFrame([*enumerate(files)], "id long, media binary")).orderBy("id").collect()
    assert [r["n_samples"] for r in out] == [512, 512, 16000, 484, None, None] and out[4]["error"]
    up, rate, _ = media.decode(bytes(out[2]["media"]))
    assert rate == 16000 and np.abs(up[::2].astype(int) - tone)[50:-50].max() < 40
    assert media.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and media.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert media.decode_blocks(block)[0, :4].tolist() == [0, 11, 41, 104]


def test_line_dedup(spark, odd):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "q\na\nb\nc\nd\nr"), (3, "b\nc\nd"), (4, "a\nb"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in linededup.without_repeated_lines(rows).collect()}
    assert found == {1: ("a\nb\nc\nd", 0), 2: ("q\nr", 4), 3: ("", 3), 4: ("a\nb", 0), 5: ("\n\n\n\n", 0), 6: ("\n\n\n\n", 0), 7: (None, 0)}
    out = linededup.without_repeated_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert linededup.without_repeated_lines(empty(odd)).count() == 0


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers(spark, odd, kind):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    f, label = (toxicity.toxicity, "toxic") if kind == "toxicity" else (quality.quality, "quality")
    held = f(docs, docs, marks).where("held_out").join(marks, "doc_id").collect()
    right = [r["predicted"] == r[label] for r in held]
    assert np.mean(right) > 0.88
    if kind == "toxicity":
        assert not [r for r in held if r["predicted"] and not r["toxic"]]
    model = (toxicity if kind == "toxicity" else quality).model(docs, marks)
    assert all(0 <= s <= 1 for s in model([b"", LONG.encode(), b"x"]))
    assert f(odd, odd, marks.where("false")).where("score = 0.5").count() == odd.count()
    assert f(empty(odd), odd, marks).count() == 0


def test_mixing(spark, odd, documents):
    assert mixing.targets([100, 100, 100], share=1.5) == [pytest.approx(200.0), pytest.approx(500 / 3), pytest.approx(250 / 3)]
    for df in (odd, documents):
        rows = mixing.mixed(df).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        assert len(rows) == df.count() and rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(df).collect()))
        for r in rows:
            assert r["size"] == len(texts[r["doc_id"]].encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3 * sum(targets.values())
    assert abs(sum(r["taken"] for r in rows) / sum(targets.values()) - 1) < 0.2
    assert mixing.mixed(empty(odd)).count() == 0


def test_archive(spark, tmp_path):
    big = "é" * 80
    pages = spark.createDataFrame([(3, "u\r\nX: y", big), (1, "u", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    rows = sorted(tuple(r) for r in warc.archived(pages, folder).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert rows == [(1, 160, "response", None), (2, 5, "response", None), (3, 160, "revisit", 1), (4, 5, "response", None), (5, 0, "response", None), (6, 160, "revisit", 1)]
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    records = {r["page_id"]: r for r in warc.read_records(spark, folder).collect()}
    texts = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert records.keys() == texts.keys()
    for i, r in records.items():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and f"urn:page:{i}>".encode() in head
        assert rest[:-4] == (b"" if b"revisit" in head else texts[i]) and r["payload_digest"] == hashlib.sha256(texts[i]).hexdigest()
    assert warc.archived(empty(pages)).count() == 0


@pytest.mark.parametrize("name", [*ORACLES])
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(tuple(map(str, (r[i] for i in at))) for r in found.fetchall()) == sorted(tuple(map(str, r)) for r in df.collect())


def test_stages_with_any_doc_id(spark, odd):
    """Null and repeated doc_ids, the latter with equal and with other columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(40, 60))) for _ in range(40)]
    rows = [(None if k % 4 == 0 else k // 8, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts)]
    rows += [(70, texts[0], "en", "a", 1), (None, texts[1], None, "b", 1), (None, texts[1], "b", None, 1), *rows[2:5], *rows[2:4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert sorted(r[1] for r in kept) == sorted(texts) and set(kept) <= set(rows)
    assert {r[1]: r[0] for r in kept} == {t: min((r[0] for r in rows if r[1] == t and r[0] is not None), default=None) for t in texts}
    for df in (docs, odd.select(*docs.columns)):
        before, after = ([tuple(r) for r in d.collect()] for d in (df, pipeline.mixing_stage(spark, df, "")))
        taken = sum(r["copies"] for r in mixing.mixed(df).collect())
        assert len(after) == taken and all(after.count(r) <= 2 * before.count(r) for r in after)
        assert {r[0] is None for r in after} == {r[0] is None for r in before}


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = simhash.save(stage(spark, docs, sf_dir), "stage")
        counts.append(out.count())
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == columns
        docs = out
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0.6 * counts[0] and counts[4] >= counts[3]
