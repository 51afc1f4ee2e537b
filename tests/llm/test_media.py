"""Operator 1 on edited copies and against an unindexed search."""

import numpy as np

from termloom.llm import media_copies as M


def test_files():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (M.decode_pnm(M.encode_pgm(x)) == x).all()
    assert M.decode_pnm(b"P6 # c\n1 1\n255\n\x03\x06\x09")[0, 0] == 6
    for bad in (None, b"", b"P5 4 4 255\nxx", b"GIF89a", b"P5 a 4 255\n"):
        assert M.decode_pnm(bad) is None
    assert M.render(None) is None and M.render([]) is None
    assert len(M.describe(np.zeros((4, 4), np.float32))[0]) == len(M.describe(np.full((60, 60), 9, np.float32))[0]) == 0


def test_copies_are_found(spark):
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(size=64).tolist()) for i in range(120)]
    vectors += [(500, vectors[3][1]), (501, None), (502, []), (3, vectors[3][1])]
    v = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(3)
    images = M.rendered(v)
    got = M.find_copies(M.rendered(v.where("id < 120 and id % 2 = 0"), copies=True), images).collect()
    right = {x.query_id for x in got if x.query_id == x.image_id}
    assert len(right) >= 0.9 * 60
    assert sum(x.query_id != x.image_id for x in got) <= 2
    same = M.find_copies(images.where("id = 3"), images).collect()
    assert [(x.image_id, x.n_copies) for x in same] == [(3, 3)]
    empty = spark.createDataFrame([], "id long, image binary")
    assert M.find_copies(empty, empty).count() == 0


def turned(image, degrees, factor, r):
    """The largest upright square within the image turned and scaled about its middle, with some noise."""
    h, w = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    n = int(min(h, w) * factor / (abs(c) + abs(s)))
    y, x = np.mgrid[0:n, 0:n] - (n - 1) / 2
    y, x = (h - 1) / 2 + (c * y - s * x) / factor, (w - 1) / 2 + (s * y + c * x) / factor
    a, b = np.clip(y.astype(int), 0, h - 2), np.clip(x.astype(int), 0, w - 2)
    fy, fx, v = y - a, x - b, image.astype(np.float32)
    out = v[a, b] * (1 - fy) * (1 - fx) + v[a, b + 1] * (1 - fy) * fx + v[a + 1, b] * fy * (1 - fx) + v[a + 1, b + 1] * fy * fx
    return np.clip(out * 0.95 + 5 + r.normal(0, 2, out.shape), 0, 255).astype(np.uint8)


def test_recall_on_crops_turns_and_scales(spark):
    """Nine of ten are found, among few and among more images."""
    for n in (60, 400):
        r = np.random.default_rng(n)
        images = [M.render(r.normal(size=64).tolist()) for _ in range(n)]
        kinds = [lambda x: M.edited(x, 7), lambda x: turned(x, 90, 1.0, r), lambda x: turned(x, 180, 1.25, r), lambda x: turned(x, 10, 1.0, r), lambda x: turned(x, 0, 0.75, r), lambda x: turned(x, 20, 1.0, r)]
        asked = [(k * 1000 + i, M.encode_pgm(f(images[i]))) for k, f in enumerate(kinds) for i in range(40)]
        a, b = (spark.createDataFrame(x, "id long, image binary").repartition(4) for x in (asked, [(i, M.encode_pgm(x)) for i, x in enumerate(images)]))
        got = {(x.query_id, x.image_id) for x in M.find_copies(a, b).collect()}
        for k in range(len(kinds)):
            assert sum((k * 1000 + i, i) in got for i in range(40)) >= 36, (n, k)
        assert sum(q % 1000 != m for q, m in got) <= 3


def test_large_images_and_files_without_corners(spark):
    r = np.random.default_rng(4)
    large = np.block([[M.render(r.normal(size=64).tolist()) for _ in range(4)] for _ in range(4)])
    assert len(M.describe(large.astype(np.float32))[0]) > 8 * len(M.describe(large[:96, :96].astype(np.float32))[0])
    flat = M.encode_pgm(np.full((30, 30), 7, np.uint8))
    rows = [(1, M.encode_pgm(large), "x"), (2, flat, "y"), (3, flat, "z"), (4, b"P5 4 4 255\nxx", "n"), (None, flat, "m"), (5, None, "k")]
    images = spark.createDataFrame(rows, "id long, image binary, sha string")
    part = spark.createDataFrame([(7, M.encode_pgm(large[200:290, 100:190])), (8, flat), (9, b"P5 4 4 255\nxx")], "id long, image binary")
    got = {(x.query_id, x.image_id): (x.n_copies, x.n_matches) for x in M.find_copies(part, images).collect()}
    assert set(got) == {(7, 1), (8, 2)} and got[8, 2] == (2, 0)


def test_tables_find_what_a_full_search_finds(spark):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(i, r.normal(size=64).tolist()) for i in range(150)], "id long, vector array<double>").repartition(3)
    q = v.where("id % 5 = 0")
    got = {(x.query_id, x.image_id) for x in M.find_copies(M.rendered(q, copies=True), M.rendered(v)).collect()}
    asked, index = (M.described(x).collect() for x in (M.rendered(q, copies=True), M.rendered(v)))
    want = set()
    for a in asked:
        for b in index:
            i, j = M.matches(a.codes, b.codes)
            p, s = (np.frombuffer(x.points, np.float32).reshape(-1, 4).astype(float) for x in (a, b))
            if M.consensus(p[i], s[j]) >= M.INLIERS:
                want.add((a.id, b.id))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 27


def test_corners_meet_at_any_number_of_rows(spark):
    """Share of corners that meet in a table by their distance, also with many more rows beside them."""
    r = np.random.default_rng(7)
    n, apart = 300, (1, 10, 15, 16, 20, 24)
    bits = r.integers(0, 2, (n, M.BITS)).astype(np.uint8)
    asked, index = [(0, np.packbits(bits, axis=1).tobytes())], [(1000, r.bytes(16 * 200_000))]
    for d in apart:
        other = bits.copy()
        for row in other:
            row[r.permutation(M.BITS)[:d]] ^= 1
        index.append((d, np.packbits(other, axis=1).tobytes()))
    q, m = (M.tables(spark.createDataFrame(x, "id long, codes binary"), *near) for x, near in ((asked, [True]), (index, [])))
    met = q.alias("q").join(m.alias("m"), "key").where("m.id < 1000 and q.no = m.no").select("m.id", "m.no").distinct().groupBy("id").count()
    share = {x.id: x["count"] / n for x in met.collect()}
    assert share[1] == share[10] == share[15] == 1 and share[16] > 0.95 and share[20] > 0.8 and share[24] > 0.65


def test_stronger_edits_found_as_by_a_full_search(spark):
    r = np.random.default_rng(8)
    images, asked = [], []
    for i in range(100):
        x = M.render(r.normal(size=64).tolist())
        y = x[8:88, 8:88].astype(np.float32) * 0.7 + r.normal(0, 3 + 2 * (i % 5), (80, 80))
        images.append((i, M.encode_pgm(x)))
        asked.append((i, M.encode_pgm(np.clip(y, 0, 255).astype(np.uint8))))
    a, b = (spark.createDataFrame(x, "id long, image binary") for x in (asked, images))
    got = {(x.query_id, x.image_id) for x in M.find_copies(a, b).collect()}
    want = set()
    q, m = (M.described(x).collect() for x in (a, b))
    for x in q:
        for y in m:
            i, j = M.matches(x.codes, y.codes)
            p, s = (np.frombuffer(z.points, np.float32).reshape(-1, 4).astype(float) for z in (x, y))
            if len(i) >= M.INLIERS and M.consensus(p[i], s[j]) >= M.INLIERS:
                want.add((x.id, y.id))
    assert got == want and len(want) > 40
