"""What the third round's findings turned up."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociscale.operators import joins, ld, stats
from lociscale.plans import catalog


def test_crowded_bins_are_joined_in_blocks(spark):
    """a bin's pairs are parted by blocks, and no small table is joined where its one file is read."""
    rows = [(1, int(p), i) for i, p in enumerate(np.random.default_rng(1).integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "g int, pos long, k int").coalesce(1)
    plan = joins.band_pairs(df, group="g", pos="pos", key="k", reach=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "__block" in plan.split("SortMergeJoin")[1].split("\n")[0]
    right = df.select("g", F.col("k").alias("other"))
    met = joins.in_blocks(df.select("g", "k"), right, ["g"], "other", most=16)
    assert met.count() == met.distinct().count() == 300 * 300


def counted(monkeypatch):
    """The rows of all that is materialised."""
    sizes, plain = [], ld.cut

    def cut(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ld, "cut", cut)
    return sizes


def test_exclusion_writes_no_pairs(spark, monkeypatch):
    """2,000 sites in 150 positions, all of them close to many."""
    sizes = counted(monkeypatch)
    rng = np.random.default_rng(2)
    rows = [(i % 2, int(p), int(o)) for i, (p, o) in enumerate(zip(rng.integers(0, 150, 2000), rng.permutation(2000), strict=True))]
    got = {r.o: r.kept for r in ld.exclusion(spark.createDataFrame(rows, "g int, p long, o int"), group="g", pos="p", order="o", apart=20).collect()}
    kept = {0: [], 1: []}
    for g, p, o in sorted(rows, key=lambda r: r[2]):
        assert got[o] == all(abs(p - q) >= 20 for q in kept[g])
        if got[o]:
            kept[g].append(p)
    assert max(sizes) <= 2000


def test_a_long_chain_of_positions_in_few_rounds(spark):
    """sites in the order of their positions, each of which hangs on the one before."""
    rows = [("a", p, p) for p in range(0, 3000, 3)]
    got = ld.exclusion(spark.createDataFrame(rows, "g string, p long, o int"), group="g", pos="p", order="o", apart=5, local=64, most=2)
    assert {r.p: r.kept for r in got.collect()} == {p: p % 6 == 0 for _, p, _ in rows}


def test_large_segments_take_few_rounds(spark, monkeypatch):
    """a segment of 1,000 nodes, one chain, by parts of 100 nodes."""
    sizes = counted(monkeypatch)
    nodes = spark.createDataFrame([(i,) for i in range(1000)], "k long")
    links = spark.createDataFrame([(i, i + 1, 1, 0.5) for i in range(999)], "left_key long, right_key long, distance long, r2 double")
    got = {r.k: r.retained for r in ld.greedy_thinning(nodes, links, key="k", local=100).collect()}
    assert got == {i: i % 2 == 0 for i in range(1000)}
    assert len(sizes) < 25


def test_large_segments_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    links = sorted({(int(a), int(a + d)) for a, d in zip(rng.integers(0, 590, 900), rng.integers(1, 12, 900), strict=True)})
    kept = {}
    for i in range(602):
        kept[i] = not any(kept[a] for a, b in links if b == i)
    nodes, edges = spark.range(602).select(F.col("id").alias("k")), spark.createDataFrame([(a, b, b - a, 0.5) for a, b in links], "left_key long, right_key long, distance long, r2 double")
    for local in (1, 16):
        assert {r.k: r.retained for r in ld.greedy_thinning(nodes, edges, key="k", local=local).collect()} == kept


def test_variant_file_of_sites_that_pass_once(spark, tmp_path):
    """suppliers 4 and 2008 write one site, of which only the first one's line passes."""
    rows = [(k, 3) for k in (4, 9, 2008, 5, 16)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["variant_file"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted(c.execute(catalog.SQL["variant_file"]).fetchall())


def test_quartiles_are_read_from_ranks(spark):
    """no aggregate gathers a group's values in one task; results are those of ``percentile``."""
    rng = np.random.default_rng(5)
    rows = [([None, "a", "b"][i % 3], float(rng.integers(0, 25)) if i % 7 else None) for i in range(200)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = stats.group_summary(df, "x", ["g"])
    assert "percentile(" not in out._jdf.queryExecution().analyzed().toString()
    want = {r.g: tuple(r.q) if r.q else (None,) * 3 for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert {r.g: (r.q25, r.median, r.q75) for r in out.collect()} == want
    halves = stats.subset_medians(df.withColumn("y", -F.col("x")), "x", "y", {"all": F.lit(True), "a": F.col("g") == "a"})
    assert "percentile(" not in halves._jdf.queryExecution().analyzed().toString()
    middle = {"all": df, "a": df.where("g = 'a'")}
    for r in halves.collect():
        m = middle[r.subset].agg(F.percentile("x", F.lit(0.5)), F.count("x")).first()
        assert (r.median_x, r.median_y, r.n) == (m[0], -m[0], m[1])


def test_ranks_are_joined_to_distinct_pairs(spark):
    """F7, F8, F9, F11: rows are summed to distinct pairs before ranks are joined to them."""
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 5, 400), strict=True))] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), (None, 1.0, 2.0), (None, 2.0, 3.0)]
    out = stats.correlations(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"])
    assert "Aggregate [g#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "AS w#" in plan
    got = {(r.g, r.method): (r.n, r.estimate) for r in out.collect()}
    for g in "ab":
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        rank = lambda v: np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])
        assert got[g, "pearson"] == (200, pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12))
        assert got[g, "spearman"] == (200, pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-12))
    assert got["c", "spearman"] == got["c", "pearson"] == (2, None)
    assert got[None, "pearson"][0] == 2 and got[None, "spearman"] == (2, None)


def test_members_meet_their_texts_before_they_are_dealt(spark, monkeypatch):
    """op9: a member of a crowded node is joined once, and only then copied to the pairs of its block."""
    from lociscale.llm import forest

    plans, plain = [], forest.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(forest, "cut", cut)
    monkeypatch.setattr(forest, "BLOCK", 4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(30)] + [(99, "quite another text of seven words here")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in forest.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 29) for i in range(30)} | {99: (99, 0)}
    dealt = [p for p in plans if "explode(sequence(0, (blocks" in p]
    assert dealt and all(p.index("explode(sequence(0, (blocks") < p.index("Join ") for p in dealt)


@pytest.mark.parametrize("held", [64, 1 << 22])
def test_draws_go_as_packed_parts(spark, monkeypatch, held):
    """draws are dealt to small parts of the rows, also where values are equal, more often drawn than a byte counts, or NaN."""
    import hashlib

    from lociscale.operators import resample

    monkeypatch.setattr(resample, "HELD", held)
    rng = np.random.default_rng(5)
    a = [1.0] * 500 + [float(x) for x in rng.integers(0, 4, 41)]
    b = [*map(float, rng.integers(-1, 3, 301)), -0.0, float("nan"), float("nan"), float("inf")]
    rows = [(i, g, v) for i, (g, v) in enumerate([("a", v) for v in a] + [("b", v) for v in b])]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k int, l string, v double")
    dealt, plain = [], resample.cut
    monkeypatch.setattr(resample, "cut", lambda df: dealt.append(plain(df)) or dealt[-1])
    got = {r.replicate: r for r in resample.pairwise_bootstrap(df, "v", "l", "a", "b", key="k", replicates=7, seed="x").collect()}
    assert dealt[0].columns == ["cell", "g", "v", "counts"] and dealt[0].count() < 7 * len(rows) / 2
    draw = lambda n, *name: [int(hashlib.sha256("|".join(map(str, ("x", *name, i))).encode()).hexdigest()[:8], 16) % n for i in range(n)]
    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    last = lambda v: np.array([1e300 if np.isnan(x) else x for x in v])
    assert sorted(got) == list(range(7))
    for rep, r in got.items():
        x, y = last([a[i] for i in draw(len(a), "true", rep)]), last([b[i] for i in draw(len(b), "false", rep)])
        assert r.median_difference == middle(x) - middle(y)
        assert r.rank_biserial == pytest.approx(np.sign(x[:, None] - y[None]).mean(), abs=1e-12)
    one = {r.replicate: r.estimate for r in resample.median_bootstrap(df.where("l = 'a'"), "v", "k", replicates=5, seed="x").collect()}
    assert one == {rep: middle([a[i] for i in draw(len(a), rep)]) for rep in range(5)}
    alone = resample.pairwise_bootstrap(df, "v", "l", "a", "nobody", key="k", replicates=2, seed="x").collect()
    assert [tuple(r)[1:] for r in alone] == [(None, None)] * 2
    assert resample.pairwise_bootstrap(df.where("false"), "v", "l", "a", "b", key="k", replicates=2, seed="x").collect() == []


def test_blocks_go_to_each_holder_once(spark, monkeypatch):
    """blocks without clusters all meet, but a block is sent once for each of a few holders, not for each block."""
    from lociscale.operators import assoc

    monkeypatch.setattr(assoc, "HOLDERS", 4)
    x = np.random.default_rng(6).integers(-3, 4, (400, 6)).astype(float)  # with ties, and sums that are exact
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    packed = assoc.near_blocks(df, "v", "k", 5, 16)
    sent = assoc.dealt_blocks(packed).select("block", "holder", "other", "targets").collect()
    blocks = {r.block for r in sent}
    assert len(blocks) >= 16 and len({(r.block, r.holder) for r in sent}) == len(sent) <= 4 * len(blocks)
    assert sorted((r.block, t) for r in sent for t in r.targets) == sorted((r.block, t) for r in packed.collect() for t in r.targets)
    assert sorted(r.block for r in sent if not r.other) == sorted(blocks)
    got = {r.key: r.neighbours for r in assoc.neighbour_sets(df, "v", "k", 5, 16).collect()}
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(away, np.inf)
    assert got == {i: np.lexsort((np.arange(400), d))[:5].tolist() for i, d in enumerate(away)}


def test_folders_of_an_index_dont_grow_with_the_span(spark, tmp_path, monkeypatch):
    """600 bins in a few folders; a fetch finds what it finds in one folder a bin, and opens no others."""
    from lociscale.sources import readers, writers

    rows = [(c, int(p)) for c in ("01", "1") for p in np.random.default_rng(10).integers(-500, 300_000, 900)]
    sites, regions = spark.createDataFrame(rows, "chrom string, pos long"), spark.createDataFrame([("1", 900, 2_100), ("1", 2_000, 9_000), ("01", -400, 400), ("01", 9, 2)], "chrom string, start long, end long")
    want = sorted({(c, p) for c, p in rows if (c == "1" and 900 <= p <= 9_000) or (c == "01" and -400 <= p <= 400)})
    for most in (1_000, 20):
        monkeypatch.setattr(writers, "FOLDERS", most)
        out = tmp_path / str(most)
        shift = writers.write_indexed_sites(sites, str(out), width=1_000)
        folders = sorted(out.glob("*/*"))
        assert (shift == 0) == (most == 1_000) and (most == 1_000 or len(folders) <= 24)
        for f in out.glob("chrom=1/bin=*/*.parquet"):
            if not 0 <= int(f.parent.name[4:]) < 10 and f != next(out.glob("chrom=*/bin=*/*.parquet")):
                f.write_bytes(b"no table")
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        spark.catalog.clearCache()
        assert sorted(set(map(tuple, readers.indexed_sites(spark, str(out), regions, width=1_000).select("chrom", "pos").collect()))) == want
    monkeypatch.setattr(writers, "FOLDERS", 2)
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"
    (tmp_path / "v.vcf").write_text(head + "".join(f"1\t{p}\t.\tA\tC\t.\tPASS\t.\tGT\t0|{p % 2}\n" for p in range(5, 9_000, 500)))
    writers.index_vcf(spark, str(tmp_path / "v.vcf"), str(tmp_path / "i"), width=100)
    assert len(list((tmp_path / "i" / "sites").glob("*/*"))) <= 3
    keys = spark.createDataFrame([("1", 5_505, "A", "C"), ("1", 5_506, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert [(r.pos, r.genotype) for r in readers.indexed_genotypes(spark, str(tmp_path / "i"), keys).select("pos", F.col(readers.indexed_genotypes(spark, str(tmp_path / "i"), keys).columns[-1]).alias("genotype")).collect()] == [(5_505, "0|1")]


def test_keys_of_a_contract_are_dealt_by_their_number(spark, monkeypatch):
    """a task holds the keys of a bounded number of rows, however many the session's partitions are."""
    from lociscale.operators import contracts
    from lociscale.plans import integrity

    dealt, plain = [], contracts.enforce
    monkeypatch.setattr(integrity, "TASK_ROWS", 100)
    monkeypatch.setattr(contracts, "enforce", lambda df, *a, **k: dealt.append((df.rdd.getNumPartitions(), k["parts"])) or plain(df, *a, **k))
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    got = {r.rule: r.rows for r in catalog.QUERIES["score_contract"](spark, folder).collect()}
    wanted = -(-lines.count() // 100)
    assert dealt == [(wanted, wanted)] and wanted > 50
    assert got["typed rows"] == lines.select("l_linenumber", "l_orderkey").distinct().count()
    monkeypatch.undo()
    rows = [("1", "5", "A", "C", "0.5")] * 3 + [("1", "6", "A", "A", "0.5"), ("1", "7", "x", "C", None), (None, "7", "x", "C", "1"), ("2", "5", "A", "C", "1")]
    for parts in (None, 3):
        with pytest.raises(contracts.ContractError) as e:
            contracts.score_table(spark.createDataFrame(rows, "chrom string, pos string, ref string, alt string, score string"), parts=parts)
        assert e.value.violations == {"chrom is missing": 1, "ref is not one canonical base": 2, "ref equals alt": 1, "score is not finite": 1, "duplicate chrom,pos,ref,alt": 1}
