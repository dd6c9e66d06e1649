"""The training-data operators against plain loops, step by step."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import fingerprint, labelled, linededup, media, mixing, packing, quality, simhash, toxicity


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def logistic(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def test_bradley_terry_step_by_step():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (200, 5)), np.ones((200, 1))], axis=1)
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0.2).astype(float)
    pairs = 600
    packed, _ = quality.learn(x, y, pairs=pairs, seed=9)

    draws = np.random.default_rng(9)
    mean, scale = [x[:, j].mean() for j in range(6)], [x[:, j].std() for j in range(6)]
    s = [[max(-8.0, min(8.0, (row[j] - mean[j]) / scale[j])) if scale[j] > 1e-6 else 0.0 for j in range(6)] for row in x.tolist()]
    good, bad = [i for i in range(200) if y[i] == 1], [i for i in range(200) if y[i] == 0]
    a, b = draws.choice(good, pairs).tolist(), draws.choice(bad, pairs).tolist()
    w, squares = [0.0] * 6, [1e-8] * 6
    for _ in range(quality.PASSES):
        for at in np.array_split(draws.permutation(pairs), max(1, pairs // quality.BATCH)):
            g = [quality.DECAY * v for v in w]
            for i in at.tolist():
                d = [s[a[i]][j] - s[b[i]][j] for j in range(6)]
                lost = 1 - logistic(sum(p * q for p, q in zip(d, w, strict=True)))  # what the loss's slope is
                g = [g[j] - lost * d[j] / len(at) for j in range(6)]
            squares = [q + v * v for q, v in zip(squares, g, strict=True)]
            w = [w[j] - quality.RATE * g[j] / math.sqrt(squares[j]) for j in range(6)]
    assert np.allclose(packed[:6], w, atol=1e-9)
    merits = sorted(sum(p * q for p, q in zip(r, w, strict=True)) for r in s)
    above = sum(m + packed[6] >= -1e-9 for m in merits)
    assert abs(above - y.sum()) <= 1  # the threshold is the quantile that leaves label 1's share above


def test_preferences_of_all_pairs():
    """Loss, gradient and threshold of quality against loops over every pair."""
    rng = random.Random(5)
    words = ["some", "plain", "words", "With", "Signs,", "x9;", "1234", "@@@", "", "..."]
    texts = [" ".join(rng.choice(words[: 6 if k % 3 else 10]) for _ in range(rng.randrange(30))).encode() for k in range(120)]
    y = np.array([int(k % 3 != 0) for k in range(120)])
    packed = [quality.cells(t) for t in texts]
    x = np.stack([quality.features(t) for t in texts]).astype(float)

    def run(make, merge):
        return functools.reduce(merge, [make(y[i : i + 13], packed[i : i + 13]) for i in range(0, 120, 13)])

    n, good, mean, squares = run(quality.moments, quality.both_moments)
    assert (n, good) == (120, 80) and np.allclose(mean, x.mean(0)) and np.allclose(squares / n, x.var(0))
    scale = np.where(np.sqrt(squares / n) > 1e-6, np.sqrt(squares / n), np.inf)
    s = np.clip((x - mean) / scale, -8, 8)

    def plain(w):
        m = (s @ w).tolist()
        loss, g = 0.0, np.zeros(len(w))
        for i in np.flatnonzero(y == 1).tolist():
            for j in np.flatnonzero(y == 0).tolist():
                loss -= math.log(logistic(m[i] - m[j])) / (80 * 40)
                g -= (1 - logistic(m[i] - m[j])) * (s[i] - s[j]) / (80 * 40)
        return loss, g

    w = np.random.default_rng(1).normal(0, 0.2, len(mean))
    loss, first, slopes = quality.preferences(*run(lambda y, p: quality.on_grid(y, quality.merits(p, w, mean, scale)), quality.both_tallies))
    g = run(lambda y, p: quality.pull(y, p, w, mean, scale, np.array([40.0, 80.0]), first, slopes), np.add)
    wanted = plain(w)
    assert abs(loss - wanted[0]) < 1e-6 and np.abs(g - wanted[1]).max() < 1e-6

    found = quality.fit(run)
    w, size = found[: len(mean)], len(mean)
    assert np.abs(plain(w)[1] + quality.DECAY * w).max() < 2e-3  # the least loss over all pairs
    merits = sorted((s @ w).tolist())
    least = merits[40]  # 80 rows or more reach it; equal texts are on one side
    lower = max(m for m in merits if m < least - 1e-9)
    assert abs(-found[size] - (lower + (least - lower) * 80 / 120)) < 1e-9
    assert (quality.scorer(found)(packed) >= 0.7).sum() == sum(m > least - 1e-9 for m in merits) >= 80


def test_quality_learns_from_all_rows(spark):
    """More labelled rows than the sample of toxicity holds; the rows behind it have another label."""
    order = F.xxhash64(F.lit("sample"), "doc_id")
    ids = [r["doc_id"] for r in spark.range(8_300).toDF("doc_id").orderBy(order, "doc_id").collect()]
    rows = [(i, f"Some plain words {i}", 1) if k < 8_100 else (i, f"{i} @@ {i} ;;", 0) for k, i in enumerate(ids)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.model(both.select("doc_id", "text"), both.select("doc_id", "quality"))([b"Some plain words 77", b"77 @@ 77 ;;"])
    assert out[0] >= 0.7 > out[1]
    found = quality.quality(both.drop("quality"), both.drop("quality"), both.select("doc_id", "quality")).join(both, "doc_id")
    assert found.count() == 8_300 and found.where("predicted = quality and held_out = (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 8_300


def test_ftrl_step_by_step():
    rng = random.Random(3)
    cells = 64
    examples = [np.array(sorted({rng.randrange(cells) for _ in range(rng.randrange(1, 12))} | ({5, 6} if k % 3 == 0 else set())), np.uint32) for k in range(200)]
    labels = np.array([float(k % 3 == 0) for k in range(200)])
    at, weights = toxicity.learn(examples, labels, cells, passes=2, seed=7)

    holders = {c: sum(c in e.tolist() for e in examples) for c in range(cells)}
    z, n = [0.0] * (cells + 1), [0.0] * (cells + 1)

    def weight(i):
        penalty = 0.0 if i == cells else toxicity.L1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + (0.0 if i == cells else toxicity.L2))

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(200).tolist():
            own = [c for c in examples[k].tolist() if holders[c] >= toxicity.LEAST_TEXTS] + [cells]
            w = {i: weight(i) for i in own}
            g = logistic(sum(w.values())) - labels[k]
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    wanted = {i: weight(i) for i in range(cells + 1) if weight(i)}
    assert at.tolist() == sorted(wanted) and np.allclose(weights, [wanted[i] for i in sorted(wanted)])
    assert len(wanted) < cells  # the penalty leaves most weights at zero


def test_grams_of_a_text():
    grams = toxicity.Grams(1 << 20)
    h = [zlib.crc32(w.encode()) for w in ("a", "bc", "a", "d")]
    mix = lambda x: ((x & 0xFFFFFFFF) ^ ((x & 0xFFFFFFFF) >> 15)) & ((1 << 20) - 1)
    pair = lambda x, y, f: mix((x * 0x9E3779B1 & 0xFFFFFFFF) + (y * f & 0xFFFFFFFF))
    wanted = [mix(x) for x in h] + [pair(h[i], h[i + 1], 0x85EBCA77) for i in range(3)] + [pair(h[i], h[i + 2], 0xC2B2AE3D) for i in range(2)]
    assert grams(b"A, bc a-D!").tolist() == wanted and not len(grams(b"")) and len(grams(b"one")) == 1


def test_bound_of_the_learning_sample(spark):
    """One labelled id that very many texts share, and texts of more cells than are learnt by."""
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    docs = docs.union(docs.where("doc_id = 2").limit(500))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    rows = labelled.sample_labels(labels, "toxic", F.lit(True), 2)
    found, y = labelled.sample_features(docs, rows, lambda t: t, 50)
    assert len(found) == len(set(found)) == len(y) == 50
    cells = np.arange(10_000, dtype=np.uint32)
    some = toxicity.few(cells, 100)
    assert len(some) == 100 and np.isin(some, toxicity.few(cells[::2], 100)).sum() >= (some % 2 == 0).sum()


def test_systematic_sampling_step_by_step(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()] + [(7, "a b c", None), (8, None, None), (8, None, None), (9, "", "zz"), (None, "d e", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in sources]
    left, free, target = 1.5 * sum(sizes), set(range(len(sources))), [0.0] * len(sources)
    weight = [(5, 2, 1)[k % 3] for k in range(len(sources))]
    while free:
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        above = [k for k in free if share[k] > 2 * sizes[k]]
        for k in above or free:
            target[k] = 2.0 * sizes[k] if above else share[k]
        left -= sum(target[k] for k in above)
        free -= set(above or free)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    salts = max(16, max(sum(r[2] == s for r in rows) for s in sources) // (mixing.ROWS_PER_PART * 16))
    wanted = []
    for k, s in enumerate(sources):
        rate = target[k] / sizes[k] if sizes[k] else 1.0
        offset = int(md5(f"mix:offset:{s or ''}")[:8], 16) / 2**32
        own = []
        for i, t, _ in (r for r in rows if r[2] == s):
            d = md5("mix:" + ("" if i is None else str(i)))
            own.append((math.floor(math.log2(size(t) + 1) * mixing.SIZE_CLASSES), int(d[:8], 16) % salts, size(t), d, i is not None, i))
        for place, r in enumerate(sorted(own, key=lambda r: r[:5]), 1):
            copies = math.floor(place * rate + offset) - math.floor((place - 1) * rate + offset)
            wanted.append((str(r[5]), str(s), r[2], sizes[k], copies, copies * r[2]))
    found = mixing.mixed(df).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], r["copies"], r["taken"]) for r in found) == sorted(wanted)
    for k, s in enumerate(sources):
        assert all(r["target"] == pytest.approx(target[k]) for r in found if r["source"] == s)


# ---- telephony audio ----------------------------------------------------------------------------


def mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return -4 * size if code & 128 else 4 * size


def alaw(code):
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = (2 * mantissa + 1) * 8 if not exponent else (2 * mantissa + 33) * 8 << (exponent - 1)
    return size if code & 128 else -size


def adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.STEPS[index]
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + media.MOVES[code & 7]))
            out.append(value)
    return out


def resampled(pcm, rate, to):
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    taps = media.kernel(up, down)
    middle, out = len(taps) // 2, []
    for k in range(0, len(pcm) * up, down):
        found = sum(taps[k + middle - q * up] * float(x) for q, x in enumerate(pcm) if 0 <= k + middle - q * up < len(taps))
        out.append(max(-32768, min(32767, round(found))))
    return out


def test_codes_and_blocks():
    assert media.MULAW_PCM.tolist() == [mulaw(c) for c in range(256)] and media.ALAW_PCM.tolist() == [alaw(c) for c in range(256)]
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5 * 40 + 13, np.uint8).tobytes()
    blocks = [data[k : k + 40] for k in range(0, len(data), 40)]
    assert media.decode_adpcm(data, 40).tolist() == [x for b in blocks for x in adpcm(b)]


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (16000, 8000), (8000, 11025), (8001, 16000), (48000, 16000)])
def test_resampling(rate, to):
    pcm = np.random.default_rng(rate).integers(-32768, 32768, 90).astype(np.int16)
    for segment in (13, media.SEGMENT):
        got, want = media.resample(pcm, rate, to, segment), resampled(pcm.tolist(), rate, to)
        assert len(got) == len(want) and np.abs(got.astype(int) - want).max() <= 1


def test_rates_out_of_bounds(spark):
    files = [media.wave(b"\0" * 64, media.MULAW, rate, 8) for rate in (0, 8000, 4_000_000_000)]
    out = media.to_pcm(spark.createDataFrame([*enumerate(files)], "id long, media binary")).orderBy("id").collect()
    assert [r["n_samples"] for r in out] == [None, 128, None] and out[0]["error"] and out[2]["error"]


def test_features_of_stored_media(spark, documents):
    short = [tuple(r) for r in documents.select("doc_id", "text").collect() if len(r["text"]) < 300][:12] + [(-1, None), (-2, "")]
    found = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert len(found) == len(short)
    for i, t in short:
        payload = (t or "").encode()
        payload += b"\0" * (-len(payload) % 64 if payload else 64)
        x = [mulaw(c) for c in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        stored = zlib.crc32(np.array(resampled(x, 8000, 16000), "<i2").tobytes())
        assert found[i]["feature"] == f"energy={sum(v * v for v in x) // len(x)} crossings={crossings} peak={max(map(abs, x))} pcm={stored:08x}"
        assert found[i]["media_sha256"] == hashlib.sha256(media.wave(payload, media.MULAW, 8000, 8)).hexdigest()


# ---- texts --------------------------------------------------------------------------------------


def test_token_ids_of_every_letter():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
    signs = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"ab{c}. {c}, x{c}́ A{c}.{c}, " for c in signs[k : k + 16]) for k in range(0, len(signs), 16)]
    texts += ["<|EndOfText|> a", "x <|endoftext|>. b", "<|STARTOFTEXT|>.", "J̌. H̱, T̈.", "", ".", "a.b. c,.", "don't. it's, 'S.", "K. K,", "w" * 500 + " " + "w" * 500]
    for at in range(0, len(texts), 500):
        for t, ids in zip(texts[at : at + 500], encode(texts[at : at + 500]), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_known_words_come_and_go():
    import pyarrow as pa

    known = packing.KnownWords(most=100)
    rng = random.Random(1)
    for _ in range(20):
        known.now += 1
        words = pa.array(list({f"w{rng.randrange(300)}" for _ in range(40)}), pa.large_string())
        first, second, short = known.hashes(words)
        assert short.all()
        at = known.find(first, second)
        for i, w in enumerate(words.to_pylist()):
            if at[i] >= 0:
                a = known.begins[at[i]]
                assert known.pool[a : a + known.sizes[at[i]]].tolist() == [int(w[1:])] * (int(w[1:]) % 3)
        new = np.flatnonzero(at < 0)
        ids = [[int(words[i].as_py()[1:])] * (int(words[i].as_py()[1:]) % 3) for i in new.tolist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        known.put(first[new], second[new], np.array([v for x in ids for v in x], "<u4"), np.cumsum(sizes) - sizes, sizes)
        assert len(known.first) <= 100 and (np.diff(known.first.astype(object)) > 0).all()


def test_near_duplicates_of_documents(spark, documents):
    """Every pair of the table that overlaps by 0.8 or more, found by counting shared shingles."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))} if words else set()
    holders: dict = {}
    for i in sorted(sets):
        for h in sets[i]:
            holders.setdefault(h, []).append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = [i for i in sorted(sets) if not sets[i]]
    links = list(zip(empty, empty[1:], strict=False))
    for i in sorted(sets):
        counts: dict = {}
        for h in sets[i]:
            for j in holders[h]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        links += [(i, j) for j, both in counts.items() if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9]
    for i, j in links:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(documents).collect()}
    assert len(links) > 30 and found == {i: top(i) for i in sets}


# ---- order min hash -----------------------------------------------------------------------------

M64, LOW24 = 2**64 - 1, (1 << 24) - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def order_min_hash(text, l=2, m_bits=6):  # noqa: E741
    """Sorts all numbered k-mers by each ordering and takes the first l."""
    words = (text or "").encode().split()
    if not words:
        return []
    runs = [words[i : i + 2] for i in range(max(1, len(words) - 1))]
    hashes = []
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w, h)
        hashes.append(h)
    seen: dict = {}
    numbered = []
    for i, h in enumerate(hashes):
        kmer = signed(h) >> 24
        seen[kmer] = seen.get(kmer, -1) + 1
        mixed = xxhash.xxh64_intdigest(seen[kmer].to_bytes(4, "little"), xxhash.xxh64_intdigest((kmer & M64).to_bytes(8, "little"), 42))
        numbered.append((mixed & ~LOW24 | i, i))
    out = []
    for m in range(1 << m_bits):

        def place(x, m=m):
            if x[0] >> (64 - m_bits) == m:
                return 0, x[0] & (2**63 - 1)
            other = xxhash.xxh64_intdigest((signed(x[0]) >> 24 & M64).to_bytes(8, "little"), xxhash.xxh64_intdigest((m >> 3).to_bytes(4, "little"), 42))
            return 1, (m & 7) << 58 ^ other >> 3 & ~LOW24 | x[1]

        chosen = sorted(i for _, i in sorted(numbered, key=place)[:l])
        h = 42
        for i in chosen:
            h = xxhash.xxh64_intdigest(hashes[i].to_bytes(8, "little"), h)
        out.append(m << 32 | h & 0xFFFFFFFF)
    return out


def test_order_min_hash_by_sorting_each_ordering(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r["text"]) < 6000]
    rows += [(-1, None), (-2, ""), (-3, "one"), (-4, "a a a a a a"), (-5, " a b\n\ta b "), (None, "first of all, a b c"), (5, rows[0][1]), (5, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = fingerprint.signatures(df, "text", "own").collect()
    assert all(list(r["own"]) == order_min_hash(r["text"]) for r in own)
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode()))
    wanted = []
    for k, (i, t) in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = order_min_hash(t), order_min_hash(edited), order_min_hash(following)
        like = lambda x, y: 1.0 if not x and not y else len({*x} & {*y}) / len({v >> 32 for v in [*x, *y]})
        wanted.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:010x}" for v in a), "".join(f"{v:010x}" for v in b), like(a, b), like(a, c)))
    for per in (20_000, 10):
        found = fingerprint.fingerprints(df, per).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(wanted)


def test_buckets_of_many_cuts(spark):
    cuts = sorted(random.Random(1).sample(range(10_000), 700))
    rows = spark.range(10_000).select("id", fingerprint.bucket_of(F.col("id"), cuts).alias("b")).collect()
    assert all(r["b"] == sum(c < r["id"] for c in cuts) for r in rows[::37])


# ---- columns of any name ------------------------------------------------------------------------


def test_clashing_columns(spark):
    rows = [(1, "a\nb\nc", "s", 1), (2, "q\na\nb\nc", "s", 2), (None, "q\na\nb\nc\nd", None, 3), (2, "other words here", None, 4), (2, "other words here", None, 4)]
    names = "starts starts_ doc_id_ text_hash_ copies copies_ copy_ key_ window rank removed_lines n_lines group row_key digest".split()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars", *[f"n_chars as `{c}`" for c in names])
    out = linededup.without_repeated_lines(df.drop("n_lines", "removed_lines"))
    assert out.count() == 5 and sorted(r["text"] for r in out.collect()) == ["", "", "other words here", "other words here", "q\na\nb\nc\nd"]
    pipeline = pytest.importorskip("corpus_pipeline")
    for stage, kept in ((pipeline.line_dedup_stage, 3), (pipeline.near_dedup_stage, 4), (pipeline.mixing_stage, None)):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        got = out.collect()
        assert all(r[c] == r["n_chars"] for r in got for c in names if stage is not pipeline.line_dedup_stage)
        assert kept is None or len(got) == kept
