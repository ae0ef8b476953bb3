import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, quality, topk
from tests.llm import corpus


def test_quality_learns_and_reads_whole_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 2
        body = corpus.words(80, i)
        if not good:  # junk stands somewhere in the text
            at = rng.randrange(60)
            body[at : at + 15] = [w.upper() + "!!" for w in body[at : at + 15]]
        rows.append((i, " ".join(body), "en", "src0", None, "n", 1, 2))
        labels.append((i, good, None))
    rows += [(1000, None, None, None, None, "n", 1, 2), (1001, "", None, None, None, "n", 1, 2), (None, "x", None, None, None, "n", 1, 2), (1002, "word " * 60000, None, None, None, "n", 1, 2)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    labelled = spark.createDataFrame([*labels, (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labelled)
    got = quality.score(docs, net, ["doc_id"]).withColumn("held_out", quality.is_held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) >= 0.9


def test_scores_do_not_depend_on_neighbours():
    net = quality.Network.fresh(1)
    texts = [b"", b"a" * 63, b"b" * 64, b"c" * 700, b"d"]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), bounds)
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)


def test_long_texts_score_like_whole_ones(monkeypatch):
    net = quality.Network.fresh(3)
    for size in (641, 1279, 1280, 1281, 6463):
        data = np.random.default_rng(size).integers(97, 101, size).astype(np.uint8)
        whole = net.scores(data, np.array([0, size]))
        with monkeypatch.context() as m:
            m.setattr(quality, "LONG", 640)
            assert (net.scores(data, np.array([0, size])) == whole).all()


def test_gradients():
    net = quality.Network.fresh(2)
    texts = [b"some text that is long enough " * 9, b"OTHER!! TEXT!! HERE!! " * 8]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data, label, weight = np.frombuffer(b"".join(texts), np.uint8), np.array([1.0, 0.0]), np.array([1.0, 0.5])
    def loss():
        s = np.clip(net.scores(data, bounds), 1e-9, 1 - 1e-9)
        return float(-(weight * (label * np.log(s) + (1 - label) * np.log(1 - s))).mean())

    grads = net.gradients(data, bounds, label, weight)
    for p, g in zip(net.parts(), grads):  # a short step along each gradient does what it promises
        old, norm = p.copy(), float(np.sqrt((g.astype(float) ** 2).sum()))
        step = 2e-3
        p[...] = old + step * g / norm
        up = loss()
        p[...] = old - step * g / norm
        down = loss()
        p[...] = old
        assert (up - down) / (2 * step) == pytest.approx(norm, rel=0.1, abs=1e-4)


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert {r.score for r in quality.score(docs, None, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), None, ["doc_id"]).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "LANE_BLOCKS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)], 1) for i in range(-60, 240)]
    rows += [(50, rows[3][1], 1), (300, rows[5][1], 1), (301, rows[5][1], 1)]  # repeated id, ties
    bad = [(400, None, 1), (450, [1.0, None] + [0.0] * 6, 1), (500, [float("nan")] * 8, 1), (550, [float("inf")] * 8, 1)]
    rows += [(600, [1.0, 2.0], 1), (650, [], 1), (None, rows[7][1], 1)]
    got = topk.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, node int").repartition(3), 5).collect()
    ints = [np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))) for _, v, _ in rows]
    want = []
    for i, (key, _, _) in enumerate(rows):
        if key is not None and key % 50 == 0:
            scored = sorted((-int(ints[i] @ ints[j]), rows[j][0] if rows[j][0] is not None else 1 << 62) for j in range(len(rows)) if j != i)[:5]
            want += [(key, r + 1, None if k == 1 << 62 else k, -s) for r, (s, k) in enumerate(scored)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)).collect() == [(0, 1, 1, -65536)]


def test_product_is_exact():
    a = np.array([[1 << 30, -(1 << 30), 3]])
    assert topk.product(a, a)[0, 0] == 2 * (1 << 60) + 9


def scene(seed, side=96):
    rng = np.random.default_rng(seed)
    grey = np.full((side, side), 128.0)
    for _ in range(40):
        y, x = rng.integers(0, side - 8, 2)
        h, w = rng.integers(6, 26, 2)
        grey[y : y + h, x : x + w] = rng.integers(0, 256)
    return grey.astype(np.uint8)


def test_image_copies(spark):
    images = {i: scene(i) for i in range(12)}
    images[20] = images[3]  # equal
    images[21] = np.ascontiguousarray(images[4][10:80, 6:90])  # cropped
    images[22] = np.clip(images[5] * 0.8 + 20, 0, 255).astype(np.uint8)  # dimmer
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes()), "x") for i, p in images.items()]
    rows += [(30, 5, 5, None, "x"), (31, 5, 5, bytearray(b"abc"), "x"), (32, 2, 2, bytearray(4), "x"), (None, *rows[0][1:4], "x"), rows[1]]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, node string")).collect()
    assert len(got) == len(rows)
    groups = {r.image_id: r.component_id for r in got if r.image_id is not None}
    assert groups == {**{i: i for i in [*range(12), 30, 31, 32]}, 20: 3, 21: 4, 22: 5}
    assert next(r for r in got if r.image_id is None).component_id == 0
    assert media.image_copies(spark.createDataFrame([], "image_id long, width int, height int, pixels binary")).count() == 0


def edited(grey, how, seed):
    if how == "noisy":
        return np.clip(grey + np.random.default_rng(seed).normal(0, 3, grey.shape), 0, 255).astype(np.uint8)
    if how == "turned":
        return np.ascontiguousarray(np.rot90(grey))
    if how == "brighter":
        return np.clip(grey * 0.9 + 25, 0, 255).astype(np.uint8)
    return np.ascontiguousarray(grey[8:-6, 5:-9])


def test_recall_of_edits():
    """At least nine in ten edited copies of each kind are found by the tables and confirmed, and no others."""
    images = [scene(100 + i) for i in range(30)]
    corners = [media.describe(x) for x in images]
    for how in ("noisy", "turned", "brighter", "cropped"):
        found = 0
        for i, grey in enumerate(images):
            copy = media.describe(edited(grey, how, i))
            for j, own in enumerate(corners):
                shared = np.isin(media.words(own), media.words(copy)).any(axis=1).sum()
                linked = shared >= media.SHARED and media.agreeing(own, copy) >= media.VOTES
                found += linked and i == j
                assert i == j or not linked
        assert found >= 27, (how, found)


@pytest.mark.parametrize("crowd", [2, 32])
def test_copies_meet_among_unrelated_images(spark, monkeypatch, crowd):
    """Crowded buckets: copies of two scenes share corners with one image of neither, the first of all."""
    monkeypatch.setattr(media, "CROWD", crowd)
    first, second = scene(1, 128), scene(2, 128)
    both = np.concatenate((first[:64], second[:64]))
    images = [both, first, second]
    images += [edited(x, "noisy", 9 + k) for k in range(3) for x in (first, second)]
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(images)]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()
    corners = [media.describe(x) for x in images]
    label = list(range(len(images)))
    for i in range(len(images)):
        for j in range(i):
            shared = min(np.isin(media.words(a), media.words(b)).any(axis=1).sum() for a, b in ((corners[i], corners[j]), (corners[j], corners[i])))
            if shared >= media.SHARED and media.agreeing(corners[i], corners[j]) >= media.VOTES:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {r.image_id: r.component_id for r in got} == dict(enumerate(label))


def plain_score(net, text):
    """The forward pass written out, byte by byte and chunk by chunk."""
    x = list(text) + [quality.PAD] * (quality.LAGS + 2 * quality.BLOCK + quality.WIDTH)
    n = max(1, -(-(len(text) + quality.LAGS) // quality.BLOCK))
    blocks = []
    for b in range(n):
        sums = np.zeros(quality.FILTERS + quality.LAGS)
        for i in range(b * quality.BLOCK, (b + 1) * quality.BLOCK):
            if x[i] != quality.PAD:
                total = net.bias.astype(float).copy()
                for k in range(quality.WIDTH):
                    total += net.tables[k][x[i + k]]
                sums[: quality.FILTERS] += np.maximum(total, 0)
                for lag in range(1, quality.LAGS + 1):
                    sums[quality.FILTERS + lag - 1] += i >= lag and x[i] == x[i - lag]
        blocks.append(sums)
    chunks = [(a + (blocks[i + 1] if i + 1 < n else 0)) / (2 * quality.BLOCK) for i, a in enumerate(blocks)]
    pooled = np.max([np.maximum(c @ net.hidden + net.hidden_bias, 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias[0])))


def test_scores_are_the_written_out_pass_in_any_batch():
    net = quality.Network.fresh(5)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, int(n)).astype(np.uint8)) for n in [0, 1, 63, 64, 65, 200, 700, 1300]] + ["Straße und ñandú. ".encode() * 9]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), bounds)
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert together.tolist() == alone
    assert np.allclose(together, [plain_score(net, t) for t in texts], rtol=0, atol=2e-6)


def test_top_k_of_empty_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, []), (50, []), (1, [1.0]), (2, [-2.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema).repartition(1), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    big = [(0, [3e6, -3e6]), (1, [4e6, 4e6]), (2, [-4e12, -4e12])]
    want = [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert topk.top_k(spark.createDataFrame(big, schema), 5).collect() == want
    for bad in ([1e16, 1e16], [1e300]):
        with pytest.raises(Exception, match="more than 63 bits"):
            topk.top_k(spark.createDataFrame([(0, bad), (1, bad)], schema), 5).collect()


@pytest.mark.parametrize("crowd", [2, 32, 1000])
def test_votes_split_over_small_and_crowded_buckets(spark, monkeypatch, crowd):
    """Two images share two corners in crowded buckets and two in small ones: enough only together."""
    monkeypatch.setattr(media, "CROWD", crowd)
    rng = np.random.default_rng(4)

    def corners(seed):
        r, out = np.random.default_rng(seed), np.zeros(24, media.CORNER)
        out["x"], out["y"], out["scale"] = r.integers(20, 200, 24), r.integers(20, 200, 24), 1
        out["bits"] = r.integers(0, 1 << 63, (24, 4)).astype(np.uint64)
        return out.tobytes()

    rows = []
    for node in range(40):  # the crowd, unlike each other
        words = rng.integers(1 << 40, 1 << 60, 24 * media.TABLES)
        words[[0, media.TABLES]] = [1, 2]
        rows.append((node, corners(node), words.tolist()))
    for node in (50, 51):
        words = rng.integers(1 << 40, 1 << 60, 24 * media.TABLES)
        words[[0, media.TABLES, 2 * media.TABLES, 3 * media.TABLES]] = [1, 2, 3, 4]
        rows.append((node, corners(99), words.tolist()))
    images = spark.createDataFrame(rows, "node long, corners binary, words array<long>")
    assert [tuple(r) for r in media._copies(images).collect()] == [(50, 51)]


def far_apart(seed, n, like=None, flipped=0):
    """Corners at random; with ``like``, its corners with so many bits of each turned over."""
    r = np.random.default_rng(seed)
    if like is not None:
        bits = np.unpackbits(np.ascontiguousarray(like["bits"]).view(np.uint8), axis=1)
        for row in bits:
            row[r.choice(256, flipped, replace=False)] ^= 1
        out = like.copy()
        out["bits"] = np.packbits(bits, axis=1).view("<u8")
        return out[:n]
    out = np.zeros(n, media.CORNER)
    out["x"], out["y"], out["scale"] = r.integers(20, 200, n), r.integers(20, 200, n), 1
    out["bits"] = r.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_links_of_descriptors_far_apart_in_all_tables(spark, monkeypatch, block):
    """Every pair that agrees is linked, also where no table has a word of both."""
    monkeypatch.setattr(media, "BLOCK", block)
    images = [far_apart(i, n) for i, n in enumerate((24, 24, 7, 6, 24, 12))]
    images += [far_apart(20, 24, images[0], media.DISTANCE), far_apart(21, 7, images[1], media.DISTANCE), far_apart(22, 24, images[2], media.DISTANCE)]
    images += [far_apart(23, 6, images[4], 1), far_apart(24, 24, images[4], media.DISTANCE + 1), far_apart(25, 24, images[0], 20)]
    want = sorted((i, j) for j in range(len(images)) for i in range(j) if media.agreeing(images[i], images[j]) >= media.VOTES)
    assert {(0, 6), (1, 7), (2, 8)} <= set(want) and not {(4, 9), (4, 10)} & set(want)
    assert not np.isin(media.words(images[0]), media.words(images[6])).any()
    rows = [(i, c.tobytes(), media.words(c).ravel().tolist()) for i, c in enumerate(images)]
    nodes = spark.createDataFrame(rows, "node long, corners binary, words array<long>")
    assert sorted(tuple(r) for r in media._copies(nodes).collect()) == want


def test_no_pair_of_enough_matches_leaves_before_the_consensus(monkeypatch):
    monkeypatch.setattr(media, "VOTES", 2)
    rng = np.random.default_rng(5)
    blocks = []
    for _ in range(2):
        images = [np.zeros(n, media.CORNER) for n in rng.integers(2, 25, 30)]
        for c in images:
            c["bits"] = np.packbits(rng.random((len(c), 256)) < 0.13, axis=1).view("<u8")
        blocks.append(images)
    starts = [np.cumsum([0, *map(len, b)])[:-1] for b in blocks]
    got = {tuple(x) for x in media.near(*(np.concatenate(b) for b in blocks), *starts).tolist()}
    want = set()
    for i, a in enumerate(blocks[0]):
        for j, b in enumerate(blocks[1]):
            close = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(axis=2) <= media.DISTANCE
            if close.any(axis=1).sum() >= 2 and close.any(axis=0).sum() >= 2:
                want.add((i, j))
    assert got == want and 0 < len(want) < 900


def test_agreement_is_the_most_of_all_proposals():
    """Matches of one corner with many hide no proposal with more different corners."""
    a, b = far_apart(1, 24), far_apart(2, 24)
    a["bits"][:4] = b["bits"][:8] = 0  # 4 x 8 matches at one shift have 4 corners of an image
    a["x"][:4], b["x"][:8], a["y"][:4], b["y"][:8] = 50, 50, 50, 50
    b["bits"][10:18], b["x"][10:18], b["y"][10:18] = a["bits"][10:18], a["x"][10:18] + 90, a["y"][10:18]
    assert media.agreeing(a, b) == 8


def moved(corners, seed, zoom, flipped):
    """A copy turned, shifted and resized by ``zoom`` steps, some corners of it elsewhere, with bits turned over."""
    r, scales = np.random.default_rng(seed), np.array(sorted(media.SCALES, reverse=True), np.float32)
    level = np.searchsorted(-scales, -corners["scale"]) + zoom
    out = far_apart(seed, len(corners), corners, flipped)[(level >= 0) & (level < len(scales))]
    level, turn = level[(level >= 0) & (level < len(scales))], int(r.integers(media.TURNS))
    ratio, angle, x, y = out["scale"] / scales[level], 2 * np.pi * turn / media.TURNS, out["x"].copy(), out["y"].copy()
    out["x"], out["y"] = ratio * (x * np.cos(angle) - y * np.sin(angle)) + 30 + r.uniform(-2, 2, len(out)), ratio * (x * np.sin(angle) + y * np.cos(angle)) - 9
    out["scale"], out["turn"] = scales[level], (out["turn"] + turn + r.integers(-1, 2, len(out))) % media.TURNS
    astray = r.random(len(out)) < 0.3
    out["x"][astray] += r.uniform(-60, 60, astray.sum())
    return out


def test_few_corners_tell_which_pairs_are_compared_in_full():
    """No link is lost, whichever zoom, side and order, though only some corners of an image meet the other's."""
    rng = np.random.default_rng(8)
    blocks = [[], []]
    for k in range(40):
        one = far_apart(k, int(rng.integers(7, 25)))
        one["x"], one["y"] = rng.uniform(0, 10, len(one)), rng.uniform(0, 10, len(one))
        one["scale"], one["turn"] = rng.choice(media.SCALES, len(one), p=(0.4, 0.4, 0.2)), rng.integers(0, media.TURNS, len(one))
        two = moved(one, k, k % 3 - 1, int(rng.integers(0, media.DISTANCE + 1)))
        blocks[k % 2].append(one)
        blocks[1 - k % 2].append(two if len(two) else one)
    a, b = (media.Side(np.concatenate(x), np.cumsum([0, *map(len, x)])[:-1]) for x in blocks)
    i, j = (x.ravel() for x in np.mgrid[:40, :40])
    for one, two, x, y in ((a, b, blocks[0], blocks[1]), (b, a, blocks[1], blocks[0])):
        want = {(p, q) for p, q in zip(i.tolist(), j.tolist()) if media.agreeing(x[p], y[q]) >= media.VOTES}
        assert {(p, q) for p, q in zip(i[media.linked(one, two, i, j)].tolist(), j[media.linked(one, two, i, j)].tolist())} == want
        zooms = {p % 3 for p, q in want if p == q}
        assert want <= set(map(tuple, media._near(one, two).tolist())) and want <= {(q, p) for p, q in media._near(two, one).tolist()} and len(zooms) == 3
    many = media.Side(np.concatenate([far_apart(k, 24) for k in range(9)]), np.arange(9) * 24)
    assert len(many.probes(np.ones(9 * 24, bool))) == 9 * (24 - media.VOTES + media.PROBES)


def test_folds_leave_out_no_match():
    """Strips meet a part of the other side's corners only, and every pair of corners within DISTANCE is found."""
    rng = np.random.default_rng(6)
    sides = []
    for _ in range(2):
        corners = np.zeros(24 * 20, media.CORNER)
        tilt = rng.integers(0, 2, (len(corners), media.FOLDS)) @ media._SIGNS.T  # far apart in the folds, near within one kind
        corners["bits"] = np.packbits((tilt > 0) ^ (rng.random((len(corners), 256)) < 0.08), axis=1).view("<u8")
        corners["scale"] = 1
        sides.append(media.Side(corners, np.arange(20) * 24))
    a, b = sides
    strips, (columns, planes, folds) = a.strips(np.inf, 1), b.wide(np.equal, 1)
    rows = np.concatenate(strips)
    apart = np.bitwise_count(a.corners["bits"][rows][:, None] ^ b.corners["bits"][None]).sum(axis=2)
    i, j = np.nonzero(apart <= media.DISTANCE)
    got = list(zip(*(x.tolist() for x in a.close(strips, columns, planes, folds)), strict=True))
    assert len(got) == len(set(got)) and set(got) == set(zip(rows[i].tolist(), j.tolist())) and 0 < len(got) < apart.size / 4
    gap = np.abs(a.folds[:, rows, None].astype(int) - b.folds[:, None].astype(int)).max(axis=0)
    assert (gap <= apart).all() and (gap > media.DISTANCE).mean() > 0.5


def test_opposite_descriptors_are_no_match():
    """All 256 bits differ: that is no distance of 0."""
    a = far_apart(3, 24)
    b = a.copy()
    b["bits"] = ~a["bits"]
    one, two, at = media.Side(a, np.zeros(1, int)), media.Side(b, np.zeros(1, int)), np.zeros(1, int)
    assert media.agreeing(a, b) == 0 and not media.linked(one, two, at, at).any() and not len(media._near(one, two))
