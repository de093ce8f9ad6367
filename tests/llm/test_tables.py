"""Operators of several steps: dedup, joins, mixing, archives, fingerprints, language models, classifiers."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, components, exact_dedup, jaccard_join, katz, merkle, mixing, quality_crf, toxicity, warc

from .cases import ROWS, documents, empty


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- exact dedup


def dedup_answers(rows):
    ids, sizes = {}, Counter(lower(t) for _, t, *_ in rows)
    for i, t, *_ in rows:
        known = ids.get(lower(t))
        ids[lower(t)] = i if known is None else known if i is None else max(known, i)
    return sorted(str((i, ids[lower(t)], sizes[lower(t)], i == ids[lower(t)])) for i, t, *_ in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.when(F.length(text) % 2 == 0, F.lit("x")).otherwise(F.substring(F.sha2(text, 256), 1, 1)).cast("binary")])
def test_dedup_exact(spark, digest):
    """The second digest makes texts collide: bytes tell them apart."""
    got = exact_dedup.dedup_exact(documents(spark), "doc_id", "text", digest=digest).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in got) == dedup_answers(ROWS)


def test_dedup_of_a_hot_text(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "a") for i in range(3000)]
    got = exact_dedup.dedup_exact(documents(spark, rows), "doc_id", "text").collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in got) == dedup_answers(rows)
    kept = exact_dedup.one_of_each_text(documents(spark, rows), "doc_id", "text")
    assert kept.count() == 1001 and kept.columns == documents(spark, rows).columns


def test_one_row_of_each_text(spark):
    """Rows that repeat id and text, ids that have a text in two cases, and groups without ids: one row stays of each text."""
    rows = [(1, "Same", "en", "a"), (1, "same", "en", "a"), (1, "same", "en", "a"), (None, "no id", "en", "a"), (None, "No id", "en", "b"), (None, "No id", "en", "b"), (2, None, "en", "a"), (3, "", "en", "a")]
    kept = exact_dedup.one_of_each_text(documents(spark, rows), "doc_id", "text").collect()
    assert sorted(str((r["doc_id"], lower(r["text"]))) for r in kept) == sorted(map(str, [(1, "same"), (None, "no id"), (3, "")]))


def test_join_by_size(spark):
    """Hot and cool keys, with more rows than the bar and fewer."""
    left = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id % 1000 + 1) as a", "id")
    right = left.groupBy("a").count().selectExpr("a as b", "count as n").filter("b <> 5")
    got = common.join_by_size(left, "a", right, "b", "n", 9000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, left.a == right.b).collect()))
    assert "Broadcast" in got._jdf.queryExecution().toString()


def test_dedup_of_nothing(spark):
    assert exact_dedup.dedup_exact(empty(spark), "doc_id", "text").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, np.uint64)
    own = exact_dedup.BinaryFuseFilter.build(keys)
    assert own.contains(keys).all()
    others = rng.integers(0, 2**63, 20_000, np.uint64)
    assert own.contains(others).mean() < 0.02


# ---- components and near copies


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, None), (5, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def near_answers(rows):
    sets = [set(jaccard_join.shingles(t or "").tolist()) for _, t, *_ in rows]
    n, pairs, links = len(rows), [], [0] * len(rows)
    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    tops = jaccard_join.forest(n, pairs)
    of = {}
    for i, t in enumerate(tops):
        if rows[i][0] is not None:
            of[t] = min(of.get(t, rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], of.get(t), links[i])) for i, t in enumerate(tops))


def near_rows():
    """Two chains of edited copies, copies with passages in common, and all the odd cases."""
    rng, rows = np.random.default_rng(5), list(ROWS)
    words = [f"w{i}" for i in range(4000)]
    for g in range(2):
        own = list(rng.choice(words, 120))
        for c in range(45):
            edited = list(own)
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                edited[at] = str(rng.choice(words))
            rows.append((100 + 100 * g + c, " ".join(edited), "en", "a"))
    passage = " ".join(rng.choice(words, 40))
    rows += [(400 + i, f"{passage} {' '.join(rng.choice(words, 60))}", "en", "a") for i in range(60)]
    return rows


@pytest.mark.parametrize("options", [{}, {"bucket": 4, "tile": 8, "levels": 2, "outsiders": 2, "direct": 6}, {"bucket": 4, "tile": 8, "link_tile": 5}])
def test_near_classes(spark, options):
    rows = near_rows()
    got = jaccard_join.near_classes(documents(spark, rows), "doc_id", "text", **options).collect()
    assert sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == near_answers(rows)


def test_near_rows_kept(spark):
    rows = near_rows()
    kept = jaccard_join.one_of_each_class(documents(spark, rows), "doc_id", "text").collect()
    classes = {a for a in (eval(x)[1] for x in near_answers(rows))} - {None}
    assert {r["doc_id"] for r in kept} - {None} == classes
    # Texts without words and ids are a class each; the rows that repeat id and text are one.
    assert len(kept) == len({r["doc_id"] for r in kept} - {None}) + sum(r["doc_id"] is None for r in kept)
    assert jaccard_join.near_classes(empty(spark), "doc_id", "text").count() == 0


def test_recall_near_the_threshold(spark):
    """Pairs of copies that are only just near: the share of links that are found, of 500 or so."""
    rng, rows, want = np.random.default_rng(14), [], {}
    for i in range(600):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        edited = list(own)
        for at in range(10, 200, int(rng.integers(42, 60))):
            edited[at] = f"x{i}"
        rows += [(2 * i, " ".join(own), "en", "a"), (2 * i + 1, " ".join(edited), "en", "a")]
        a, b = (set(jaccard_join.shingles(t).tolist()) for _, t, *_ in rows[-2:])
        want[2 * i] = int(5 * len(a & b) >= 4 * len(a | b))
    assert sum(want.values()) > 300
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.near_classes(documents(spark, rows), "doc_id", "text").collect()}
    found = sum(got[i] for i in want)
    assert found >= 0.995 * sum(want.values()) and all(got[i] <= n for i, n in want.items())


def test_shingles():
    assert len(jaccard_join.shingles("")) == 0 and len(jaccard_join.shingles(" \n")) == 0
    assert len(jaccard_join.shingles("one")) == 1 and len(jaccard_join.shingles("a b c d e f")) == 2
    assert (jaccard_join.shingles("A B c d E") == jaccard_join.shingles("a b  c\td e")).all()
    assert jaccard_join.runs_for(0.9999) == 4


# ---- mixing


def test_targets(spark):
    base = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "_source string, _size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(base, mixing.Mix()).collect()}
    # 3765 words over weights 5, 2, 1, 5: a stops at 20, null at 1000; b at 2000 of what is left, c has the rest.
    assert sum(got.values()) == pytest.approx(3765)
    assert got["a"] == 20 and got[None] == 1000 and got["b"] == pytest.approx(2 / 3 * 2745) and got["c"] == pytest.approx(2745 / 3)


def test_mix_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", ["a", "b", "c", "d", None][min(i % 7, 4)]) for i in range(3000)]
    docs = documents(spark, rows)
    got = mixing.mix_documents(docs, "doc_id", "text", "source").collect()
    again = mixing.mix_documents(docs.repartition(5), "doc_id", "text", "source").collect()
    assert sorted(got) == sorted(again)
    source = {i: s for i, _, _, s in rows}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        size[source[r["doc_id"]]] += r["size"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["size"] == len((rows[r["doc_id"]][1]).split())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 30 and t <= 2 * size[s] + 1e-9
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(docs, "doc_id", "text", "source").collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def pareto(rows, luck):
    """The mix by a full sort of each source, straight from its definition: copies by id."""
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    by_source = {}
    for i, _, _, s in rows:
        by_source.setdefault(s, []).append(i)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(sizes[i] for i in own) for s, own in by_source.items()}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] < weight[s] * level}
        for s in full or free:
            target[s] = 2 * total[s] if full else weight[s] * level
        left -= sum(2 * total[s] for s in full)
        free = free - full if full else set()
    copies = {}
    for s, own in by_source.items():
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        copies |= dict.fromkeys(own, whole)
        if rest < 0.5:
            continue
        down, certain = sorted((i for i in own if sizes[i]), key=lambda i: -sizes[i]), set()
        while True:
            drawn = [i for i in down if i not in certain]
            pull = (rest - sum(sizes[i] for i in certain)) / sum(sizes[i] ** 1.5 for i in drawn) if drawn else math.inf
            most = [i for i in drawn if sizes[i] == sizes[drawn[0]]]
            if not drawn or pull * math.sqrt(sizes[drawn[0]]) < 1:
                break
            certain |= set(most)
        odds = lambda p: p / (1 - p)
        ranked = sorted(drawn, key=lambda i: odds(luck[i]) / odds(pull * math.sqrt(sizes[i])))
        words = 0
        for i in certain:
            copies[i] += 1
            words += sizes[i]
        for i in ranked:
            if words + sizes[i] / 2 > rest:
                break
            copies[i] += 1
            words += sizes[i]
    return copies


@pytest.mark.parametrize("options", [{}, {"LAST_ROWS": 3, "BINS": 4}, {"BROADCAST_ROWS": 1}])
def test_mix_equals_a_full_sort(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(mixing, name, value)
    rng = np.random.default_rng(13)
    rows = [(i, "w " * int(rng.zipf(1.7) % 300), "en", ["a", "b", "c", None][min(int(rng.integers(0, 6)), 3)]) for i in range(1500)]
    docs = documents(spark, rows)
    luck = {r["doc_id"]: r["l"] for r in docs.select("doc_id", mixing.luck_of("doc_id", "text").alias("l")).collect()}
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(docs, "doc_id", "text", "source").collect()}
    assert got == pareto(rows, luck)


def test_mix_of_odd_rows(spark):
    got = mixing.mix_documents(documents(spark), "doc_id", "text", "source").collect()
    assert len(got) == len(ROWS) and all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixing.mix_documents(empty(spark), "doc_id", "text", "source").count() == 0
    nothing = documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert [r["taken"] for r in mixing.mix_documents(nothing, "doc_id", "text", "source").collect()] == [0, 0]


# ---- WARC


def test_bundles(tmp_path):
    import zstandard

    uri = f"file://{tmp_path}/x.warc.zst"
    payloads = [b"hello " * i for i in range(40)]
    made = [warc.make_record(str(i), f"http://a/{i} b\r\n", p, warc.digest_of(p), "7" if i % 2 else None, bool(i % 2)) for i, p in enumerate(payloads)]
    writer = warc.BundleWriter(uri, frame_bytes=1500)
    places = [writer.add(r) for _, r in made]
    writer.close()
    reader = warc.BundleReader(uri)
    assert [reader.record(*p) for p in places] == [r for _, r in made]
    assert len(reader.frames) > 5
    data = (tmp_path / "x.warc.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as plain:
        assert plain.read() == b"".join(r for _, r in made)
    data, at, heads = b"".join(r for _, r in made), 0, []
    while at < len(data):
        head, _, _, at = warc.parse_record(data, at)
        heads.append(head)
    assert [h["warc-record-id"].decode().strip("<>") for h in heads] == [i for i, _ in made]


PAGES = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\nX: y", "<p>y</p>"), (3, "http://c\nX: y", "<p>y</p>"), (4, "u", None), (5, "u", ""), (None, "u", "<p>x</p>"), (None, "u", "only null"), (6, "u", "é漢\r\n\r\nWARC/1.1\r\n" * 100)]


def test_round_trip(spark):
    import base64

    pages = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, id int, record_type string")
    got = warc.archive_round_trip(pages, "page_id", "url", "html").collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data, keep = (h or "").encode(), best[h or ""]
        first = i == (None if keep < 0 else keep)
        want.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else keep)))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    assert warc.archive_round_trip(pages.limit(0), "page_id", "url", "html").count() == 0


def test_records_by_identifier(spark, tmp_path):
    """Every record by its place in the index, with identifiers of any characters; one record reads one frame."""
    ids = ["a", "x\r\nWARC-Type: revisit", "x\r\n\r\ny", "%0D", " space ", "é漢", "", "n" * 300]
    pages = spark.createDataFrame([(i, f"http://a/{n}", f"<p>{n // 2}</p>" * 50) for n, i in enumerate(ids * 4)], "page_id string, url string, html string").dropDuplicates()
    folder = f"file://{tmp_path}/bundles"
    index = warc.write_archive(pages, "page_id", "url", "html", folder, frame_bytes=2000)
    assert index.select("bundle", "frame").distinct().count() > 3
    every = {r["record_id"]: r for r in warc.read_archive(index, folder).collect()}
    assert {r["page_id"] for r in every.values()} == set(ids)
    for r in index.collect():
        reader = warc.BundleReader(f"{folder}/{r['bundle']}")
        head, _, payload, _ = warc.parse_record(reader.record(r["frame"], r["offset"], r["length"]))
        assert warc.unescaped(head.get("page-id", b"").decode()) == r["page_id"] and head["warc-record-id"].decode() == f"<{r['record_id']}>"
        reader.close()
    wanted = spark.createDataFrame([(i,) for i in list(every)[:3]] + [("urn:uuid:none",)], "record_id string")
    assert {r["record_id"]: r for r in warc.find_records(index, folder, wanted).collect()} == {i: every[i] for i in list(every)[:3]}
    back = warc.archive_round_trip(pages, "page_id", "url", "html")
    assert sorted(r["page_id"] for r in back.collect()) == sorted(r["page_id"] for r in pages.collect())


# ---- fingerprints


def test_trees():
    text = "\n".join(f"paragraph {i} with some words of its own, number {i * i}" for i in range(60)).encode()
    own = merkle.tree(text)
    assert own.size == len(text) and merkle.tree(text) == own and merkle.likeness(own, own) == 1
    changed = text.replace(b"number 900", b"number 901")
    other = merkle.tree(changed)
    assert own.digest != other.digest and 0.9 < merkle.likeness(own, other) < 1
    at = merkle.first_difference(own, other)
    where = text.index(b"number 900")
    assert at <= where + 10 and where - at < 200
    moved = merkle.tree(b"a new line\n" + text)
    assert merkle.likeness(own, moved) > 0.9
    assert merkle.likeness(merkle.tree(b""), merkle.tree(b"")) == 1 and merkle.likeness(merkle.tree(b""), own) == 0
    assert merkle.tree(b"a\nb").digest != merkle.tree(b"ab\n").digest


def plain_likeness(a, b):
    """By nested lists of branches, without digests: what one tree has of the other's branches, level by level."""

    def cut(data):
        raw, leaves, start = np.frombuffer(data, np.uint8), [], 0
        for i in range(len(data)):
            rolled = 0
            for x in raw[max(0, i - merkle.WINDOW + 1) : i + 1].tolist():
                rolled = (rolled * 2 + int(merkle._GEAR[x])) % 2**32
            if rolled >> (32 - merkle.LEAF_BITS) == 0 or raw[i] == 10 or i == len(data) - 1 or i + 1 - start == merkle.LEAF_MOST:
                leaves.append(data[start : i + 1])
                start = i + 1
        paragraphs, sections = [[]], [[]]
        for leaf in leaves:
            paragraphs[-1].append(leaf)
            if leaf.endswith(b"\n"):
                paragraphs.append([])
        for p in filter(None, paragraphs):
            sections[-1].append(tuple(p))
            digest = hashlib.sha256(b"paragraph" + len(p).to_bytes(4, "big") + b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in p)).digest()
            if (len(p) == 1 and p[0].endswith(b"\n") and not p[0].strip()) or (len(p) == 1 and not p[0].strip()) or digest[0] % merkle.SECTION == 0:
                sections.append([])
        return [tuple(x) for x in sections if x]

    size = lambda n: len(n) if isinstance(n, bytes) else sum(map(size, n))
    left, right, shared = cut(a), cut(b), 0
    while left and right and isinstance(left[0], (tuple, bytes)):
        common = Counter(left) & Counter(right)
        shared += sum(size(x) * n for x, n in common.items())
        left, right = list((Counter(left) - common).elements()), list((Counter(right) - common).elements())
        if isinstance(left[0] if left else b"", bytes):
            break
        left, right = [c for x in left for c in x], [c for x in right for c in x]
    return 1.0 if a == b else min(1.0, 2 * shared / (len(a) + len(b)))


def test_likeness_equals_plain_branches():
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(60)]
    text = lambda: "\n".join(" ".join(rng.choice(words, int(rng.integers(0, 14)))) for _ in range(int(rng.integers(1, 30))))
    for _ in range(60):
        a, b = text(), text()
        c = merkle.edited(a, b)
        for x, y in ((a, b), (a, c), (b, c), (a, a + "\n" + b)):
            assert merkle.likeness(merkle.tree(x.encode()), merkle.tree(y.encode())) == pytest.approx(plain_likeness(x.encode(), y.encode()))


def test_fingerprint_documents(spark):
    rows = [r for r in ROWS if r[0] is not None and r[:2] != (6, "one two")] + [(20 + i, f"text {i} " * i, "en", "a") for i in range(60)]
    got = {r["doc_id"]: r for r in merkle.fingerprint_documents(documents(spark, rows).repartition(3), "doc_id", "text").collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        want = (t[: len(t) - n] + following[:n]).encode()
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["fingerprint"] == merkle.tree(t.encode()).digest.hex() and r["edited_fingerprint"] == merkle.tree(want).digest.hex()
        trees = [merkle.tree(x) for x in (t.encode(), want, following.encode())]
        assert r["near_edited"] == merkle.likeness(trees[0], trees[1]) and r["near_next"] == merkle.likeness(trees[0], trees[2])
    # Null ids come first, rows of one id by the hash of their text.
    odd = merkle.fingerprint_documents(documents(spark), "doc_id", "text").collect()
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, *_ in ROWS], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    ordered = sorted(((i is not None, i or 0, hashed[t or ""], t or "") for i, t, *_ in ROWS))
    pairs = [(o[3], ordered[(k + 1) % len(ordered)][3]) for k, o in enumerate(ordered)]
    assert Counter((r["fingerprint"], r["near_next"]) for r in odd) == Counter((merkle.tree(a.encode()).digest.hex(), merkle.likeness(merkle.tree(a.encode()), merkle.tree(b.encode()))) for a, b in pairs)
    assert merkle.fingerprint_documents(documents(spark, ROWS[:1]), "doc_id", "text").first()["near_next"] == 1
    assert merkle.fingerprint_documents(empty(spark), "doc_id", "text").count() == 0


# ---- language model


def katz_answers(rows, order):
    """The model by dictionaries, straight from its definition."""
    docs = [[*lower(t).replace("\x0b", " ").replace("\x0c", " ").split(), None] for _, t, *_ in rows]
    trains = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, *_ in rows]
    contexts = lambda d, k: [tuple([None] * (k - 1) + d[:-1])[j : j + k - 1] for j in range(len(d))]
    counts = {k: Counter() for k in range(1, order + 1)}
    for d, train in zip(docs, trains):
        if train:
            for k in counts:
                counts[k].update(zip(contexts(d, k), d))
    one = Counter({w: n for (_, w), n in counts[1].items()})
    hist = {k: katz.histogram(np.array(list(c.values()), np.int64)) for k, c in counts.items()}
    uni, factors = katz.Unigrams(hist[1]), {k: katz.discounts(h) for k, h in hist.items()}
    follow = {k: {} for k in counts}
    for k, c in counts.items():
        for (h, w), n in c.items():
            follow[k].setdefault(h, {})[w] = n

    def parts(h):
        """What a context's words get, and the weight of all others."""
        k, seen = len(h) + 1, follow[len(h) + 1][h]
        total = sum(seen.values())
        left = {w: c * (factors[k][c - 1] if c <= katz.K else 1) / total for w, c in seen.items()}
        freed = 1 - sum(left.values())
        if all(c > katz.K for c in seen.values()):
            left, freed = {w: p * total / (total + 1) for w, p in left.items()}, 1 / (total + 1)
        return left, freed / max(1 - sum(q(h[1:], w) for w in seen), 1e-12)

    known = {}

    def q(h, w):
        if not h:
            return float(uni.p(np.array([one[w]]))[0])
        if h not in follow[len(h) + 1]:
            return q(h[1:], w)
        if h not in known:
            known[h] = parts(h)
        return known[h][0][w] if w in known[h][0] else known[h][1] * q(h[1:], w)

    kinds, total = len(one), sum(one.values())
    answers = []
    for (i, *_), doc in zip(rows, docs):
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in doc)
        answers.append((i, len(doc), sum(one[w] > 0 for w in doc), total, base, sum(math.log10(q(h, w)) for h, w in zip(contexts(doc, order), doc))))
    sums = [sum(q(h, w) for w in one) + q(h, "\0never") for k in follow for h in list(follow[k])[:12]]
    return answers, sums


@pytest.mark.parametrize("order, hot", [(1, None), (2, None), (3, None), (4, None), (3, 5.0)])
def test_katz(spark, monkeypatch, order, hot):
    """Every order against dictionaries; the last with nearly all contexts hot. Some contexts have no count that is discounted."""
    if hot:
        monkeypatch.setattr(katz, "Order", lambda buckets, _, made=katz.Order: made(buckets, hot))
    rng = np.random.default_rng(9)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 5000) if x < 10_000]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]), "en", "a") for i in range(100)] + [(i, t if t is None else t[:3000], la, s) for i, t, la, s in ROWS]
    rows += [(500 + i, "always the same words in the same order", "en", "a") for i in range(20)]
    want, sums = katz_answers(rows, order)
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)
    got = katz.score_documents(documents(spark, rows), "doc_id", "text", order=order, chunk_tokens=500, bucket_entries=300).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_katz_without_rows(spark):
    assert katz.score_documents(empty(spark), "doc_id", "text").count() == 0
    none = katz.score_documents(documents(spark, [(i, "a b", "en", "a") for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1]), "doc_id", "text").collect()
    assert none and all(r["held_out"] and r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in none)


def test_katz_with_groups_of_copies():
    """Copies bend the counts of counts; Good-Turing still frees what there is in counts of 1, and no count loses all or gains."""
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 40_000) if x < 100_000]
    texts = [" ".join(words[i * 60 : i * 60 + 60]) for i in range(len(words) // 60)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + [t for t in texts[:80] for _ in range(4)])]
    docs = [[*t.split(), None] for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    for counted in (Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip([d[-1], *d[:-1]], d))):
        hist = katz.histogram(np.array(list(counted.values()), np.int64))
        n = Counter(counted.values())
        assert any((r + 1) * n[r + 1] > r * n[r] for r in range(1, katz.K + 1))
        found = katz.discounts(hist)
        assert all(0 < d < 1 for d in found)
        assert sum(r * n[r] * (1 - d) for r, d in zip(range(1, katz.K + 1), found)) == pytest.approx(n[1])


def test_katz_without_bends_is_plain_good_turing():
    n = {1: 660501, 2: 173283, 3: 73669, 4: 42244, 5: 33576, 6: 22558}
    top = 6 * n[6] / n[1]
    assert katz.discounts(n) == pytest.approx([((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, 6)])


# ---- classifiers

PROSE = ["The cat sat on the mat and looked at us.", "It was a fine day, and nobody said much.", "Later we went home by the old road.", "She read a book about ships and storms."]
JUNK = ["buy | now | cheap | pills | here |", "CLICK!! HERE!! NOW!! BEST!! OFFER!!", "win win win win win win win win", "a$$$ b### c%%% d&&& e*** f$$$"]


def labelled(spark, good, bad, column):
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(rng.choice(good if i % 3 else bad, 4)), "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(None, 1), (5, None), (900, 7)], f"doc_id long, {column} int")
    return rows, labels


def test_chain_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    unary, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    weights = {}
    for y in itertools.product((0, 1), repeat=6):
        weights[y] = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:])))
    z = sum(weights.values())
    good, expected, log_z = quality_crf.chain(unary, moves)
    assert log_z == pytest.approx(math.log(z))
    assert good == pytest.approx([sum(w for y, w in weights.items() if y[i]) / z for i in range(6)])
    want = [[sum(w * sum((p, q) == (a, b) for p, q in zip(y, y[1:])) for y, w in weights.items()) / z for b in (0, 1)] for a in (0, 1)]
    assert expected == pytest.approx(np.array(want))


def test_score_quality(spark):
    rows, labels = labelled(spark, PROSE, JUNK, "quality")
    docs = documents(spark, rows + [(1000 + i, t, a, b) for i, (_, t, a, b) in enumerate(ROWS)])
    got = quality_crf.score_quality(docs, "doc_id", "text", labels, per_class=60).collect()
    assert len(got) == 300 + len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and all((r["predicted"] == 1) == bool(r["doc_id"] % 3) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    good = quality_crf.good_documents(docs, "doc_id", "text", labels, per_class=60)
    assert good.columns == docs.columns and good.count() == sum(r["predicted"] for r in got)


@pytest.mark.parametrize("module, column", [(quality_crf.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_without_labels(spark, module, column):
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    assert {r["score"] for r in module(documents(spark), "doc_id", "text", none).collect()} == {0.5}
    assert module(empty(spark), "doc_id", "text", none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(10)], f"doc_id long, {column} int")
    assert all(r["score"] > 0.9 for r in module(documents(spark), "doc_id", "text", ones).collect())


def test_score_toxicity(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(rng.choice(words, 40))
        if i % 4 == 0:
            own[int(rng.integers(40))] = "Scoundrel!"
            own[int(rng.integers(40))] = "rascal"
        rows.append((i, " ".join(own), "en", "a"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows + [(1000, None, "en", "a"), (1001, "", "en", "a")]), "doc_id", "text", labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert len({r["score"] for r in got if r["doc_id"] >= 1000}) == 1


def test_toxicity_learns_from_whole_texts(spark):
    """What makes these documents toxic comes after more than 2,000 words."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(80):
        own = list(rng.choice(words, 2100))
        rows.append((i, " ".join(own + ["vile", "wretched", "scoundrel"] * 4 if i % 2 else own + list(rng.choice(words, 12))), "en", "a"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows), "doc_id", "text", labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)


def kneser_ney(counts, both):
    """Interpolated Kneser-Ney by dictionaries: p(gram) for grams of characters, of one class."""

    def levels(top):
        out = {toxicity.ORDER: top}
        for k in range(toxicity.ORDER - 1, 0, -1):
            out[k] = Counter()
            for g, n in out[k + 1].items():
                out[k][g[1:]] += n if k > 1 and g[1] == "^" else 1
        return out

    def off(level):
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        found = [r - (r + 1) * y * n[r + 1] / n[r] if n[r] else 0.5 for r in (1, 2, 3)]
        return [0.0, *(d if 0 < d < r else 0.5 for r, d in zip((1, 2, 3), found))]

    own, shared = levels(counts), levels(both)
    offs = {k: off((shared if k <= toxicity.SHARED else own)[k]) for k in own}

    def p(gram, kinds, k=toxicity.ORDER):
        if not k:
            return 1 / kinds
        level, g = (shared if k <= toxicity.SHARED else own)[k], gram[-k:]
        follow = {x: n for x, n in level.items() if x[:-1] == g[:-1]}
        total, lower = sum(follow.values()), p(gram, kinds, k - 1)
        if not total:
            return lower
        freed = sum(offs[k][min(n, 3)] for n in follow.values())
        return (max(level[g] - offs[k][min(level[g], 3)], 0) + freed * lower) / total

    return p


def test_models_equal_dictionaries():
    """Every order of both models, by probabilities of seen, rare and unseen spellings; and each context's sum to 1."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 7)))) for _ in range(80)]
    texts = [Counter({w: int(n) for w, n in zip(words[i * 30 :], rng.zipf(1.6, 50) % 40 + 1)}) for i in (0, 1)]
    alphabet = toxicity.alphabet_of(Counter("".join(words)))
    codes, counts, grams = {}, [], [Counter(), Counter()]
    for y, own in enumerate(texts):
        for w, n in own.items():
            padded = "^" * (toxicity.ORDER - 1) + w + "$"
            for i, code in enumerate(toxicity.spellings([w], alphabet)[0].tolist()):
                gram = padded[i : i + toxicity.ORDER]
                codes[code] = gram
                grams[y][gram] += n
    order = sorted(codes)
    counts = np.array([[g[codes[c]] for c in order] for g in grams])
    models = toxicity.Models(alphabet, np.array(order, np.uint64), counts)
    brute = [kneser_ney(g, grams[0] + grams[1]) for g in grams]
    new = ["abcde", "zz", "éa", "bbbbbbbb", words[0], words[-1]]
    for w in new:
        own = toxicity.spellings([w], alphabet)[0]
        padded = "^" * (toxicity.ORDER - 1) + w + "$"
        got = models.probabilities(own)
        for i in range(len(own)):
            assert got[:, i] == pytest.approx([p(padded[i : i + toxicity.ORDER], models.kinds) for p in brute])
        ratio, length = models.evidence([w])
        assert ratio[0] == pytest.approx(float(np.log(got[1] / got[0]).sum())) and length == [len(w) + 1]
    for context in ("^^^^", "^^ab", "abcd", "éééé"):
        number = {c: i + 3 for i, c in enumerate(map(chr, alphabet))} | {"^": toxicity.START}
        base = sum(number[c] << (toxicity.BITS * (4 - i)) for i, c in enumerate(context))
        every = np.array([base | x for x in (toxicity.END, toxicity.RARE, *range(3, 3 + len(alphabet)))], np.uint64)
        assert models.probabilities(every).sum(1) == pytest.approx([1.0, 1.0])
    text = "abc abc zz"
    assert models.reader()([text, ""]) == pytest.approx([sum(n * models.evidence([w])[0][0] for w, n in (("abc", 2), ("zz", 1))) / 11, 0.0])
    assert toxicity.Models(alphabet[:0], np.zeros(0, np.uint64), np.zeros((2, 0))).reader()(["x y"]) == [0.0]


@pytest.mark.parametrize("module, column", [(quality_crf.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_with_repeated_ids(spark, module, column):
    """Labelled ids that repeat, with other texts and the same, give the same scores whatever the rows' order."""
    rows, labels = labelled(spark, PROSE, JUNK, column)
    rows = rows[:60] + [(i, f"{t} once more", "en", "a") for i, t, *_ in rows[:60]] + rows[:60]
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in module(documents(spark, rows).repartition(n), "doc_id", "text", labels, per_class=10).collect()) for n in (1, 3)]
    assert scores[0] == scores[1] and len(scores[0]) == 180


def test_lines_of_mixed_documents(spark):
    """Poor documents here have plain first lines: they are good, the others bad."""
    rng = np.random.default_rng(11)
    junk = lambda: "\n".join(rng.choice(JUNK, 4))
    rows = [(i, "\n".join(rng.choice(PROSE, 5)) if i % 2 else f"{rng.choice(PROSE)}\n{junk()}", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    for r in quality_crf.good_lines(documents(spark, rows), "doc_id", "text", labels, per_class=80).collect():
        assert all(p >= 0.5 for p in r["goods"]) if r["doc_id"] % 2 else r["goods"][0] >= 0.5 and all(p < 0.5 for p in r["goods"][1:])


def test_told_meets_the_label():
    """The tilt gives the demanded share, and none is needed where the label holds already."""
    rng = np.random.default_rng(12)
    unary, moves, sizes = rng.normal(size=9), rng.normal(size=(2, 2)), rng.integers(1, 50, 9).astype(float)
    free = quality_crf.chain(unary, moves)[0] @ sizes / sizes.sum()
    for label in (0, 1):
        share = quality_crf.told(unary, moves, sizes, label)[0] @ sizes / sizes.sum()
        holds = free >= quality_crf.GOOD_LEAST if label else free <= quality_crf.GOOD_MOST
        assert share == pytest.approx(free if holds else quality_crf.GOOD_LEAST if label else quality_crf.GOOD_MOST, abs=0.01)


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [". ".join(" ".join(rng.choice(words, 12)) for _ in range(6)) + "." for _ in range(60)]
    junk = ["BUY!! NOW!! " * 30 for _ in range(40)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), "en", "a") for i in range(5)] + [(200 + i, texts[i] + " one more", "en", "b") for i in range(10, 15)]
    rows += [(300 + i, t, "en", "a") for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in now.collect()})
    assert kept[0] & set(range(300, 340)) == set() and len(kept[0]) == 70
    assert kept[1] == kept[0] - set(range(5))
    assert kept[2] == kept[1] - {200 + i for i in range(10, 15)}
    out = pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in now.collect())
    assert out.agg(F.min("n_tokens")).first()[0] > 0


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, very long texts, clashing columns; and no rows at all: every stage keeps df's columns, and encodes each row that is left."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 11)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark), empty(spark)):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert out.columns == docs.columns if name != "encode" else len(rows) == n
            assert bool(rows) <= bool(n)
        left = pipeline.exact_dedup(spark, docs, str(tmp_path)).collect()
        assert len(left) == len({lower(r["text"]) for r in docs.collect()})
