"""Graph files of several splits and several files, stored graphs, and the command line."""

import gzip

import pytest
from pyspark.sql import functions as F

from walkloom import cli
from walkloom.plans.report import query_arguments
from walkloom.sources import gfa, stored


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "7000")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def numbered(n):
    return [f"S\t{i}\t{'ACGT' * (i % 9)}" if i % 50 else "" for i in range(n)]


def test_lines_of_many_splits_keep_their_order(spark, tmp_path, small_splits):
    lines = numbered(12_000)
    (tmp_path / "big.gfa").write_text("\n".join(lines))
    (tmp_path / "other.gfa").write_text("\r\n".join(lines[:500]) + "\r\n")
    (tmp_path / "packed.gfa.gz").write_bytes(gzip.compress("\n".join(lines[:3000]).encode()))
    read = gfa.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "big.gfa")).rdd.getNumPartitions() >= 8
    rows = read.collect()
    for name, want in (("big", lines), ("other", lines[:500]), ("packed", lines[:3000])):
        got = sorted((r.line_pos, r.value) for r in rows if r.locus_id == name)
        assert len({p for p, _ in got}) == len(got) and [v for _, v in got] == [x for x in want if x]
    same = gfa.lines_of(spark, {"big": "\n".join(lines)}).orderBy("line_pos").select("value").collect()
    assert read.filter("locus_id = 'big'").orderBy("line_pos").select("value").collect() == same


def test_one_locus_of_several_files(spark, tmp_path, small_splits):
    lines = numbered(6000)
    for k in range(3):
        (tmp_path / f"a {k}+%.gfa").write_text("\n".join(lines[2000 * k : 2000 * k + 2000]))
    got = gfa.read_lines(spark, str(tmp_path), "all").orderBy("line_pos").collect()
    assert [r.value for r in got] == [x for x in lines if x] and {r.locus_id for r in got} == {"all"}


def test_written_lines_are_read_in_order(spark, tmp_path, small_splits):
    lines = gfa.lines_of(spark, {f"L{k}": "\n".join(numbered(700 + k)) for k in range(4)})
    gfa.write_lines(lines.repartition(5), str(tmp_path / "out"))
    back = gfa.read_lines(spark, str(tmp_path / "out"))
    for k in range(4):
        one = f"locus_id = 'L{k}'"
        assert back.filter(one).orderBy("line_pos").select("value").collect() == lines.filter(one).orderBy("line_pos").select("value").collect()


#: Two contigs of ten 10-base nodes each, with a side node at every third place; own graph.
def two_contigs():
    out, walks = ["H\tVN:Z:1.1\tRS:Z:ref"], []
    for c, first in (("c1", 100), ("c2", 200)):
        ids = [first + i for i in range(10)]
        out += [f"S\t{i}\tACGTACGTAC" for i in ids] + [f"S\t{first + 50 + k}\tGG" for k in range(3)]
        out += [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in zip(ids, ids[1:])]
        alt = list(ids)
        for k in range(3):
            out += [f"L\t{ids[3 * k]}\t+\t{first + 50 + k}\t+\t0M", f"L\t{first + 50 + k}\t+\t{ids[3 * k + 2]}\t+\t0M"]
            alt[3 * k + 1] = first + 50 + k
        walks += [f"W\tref\t0\t{c}\t1000\t1100\t" + "".join(f">{i}" for i in ids), f"W\talt\t1\t{c}\t0\t76\t" + "".join(f">{i}" for i in alt)]
    return "\n".join(out + walks)


def brute_cut(text, contig, start, end, context):
    """Ids in the subgraph, by Dijkstra's rule on the text itself."""
    length, near, walks = {}, {}, []
    for line in text.split("\n"):
        f = line.split("\t")
        if f[0] == "S":
            length[f[1]] = len(f[2])
        elif f[0] == "L":
            near.setdefault(f[1], set()).add(f[3])
            near.setdefault(f[3], set()).add(f[1])
        elif f[0] == "W":
            walks.append((f[1], f[3], int(f[4]), f[6][1:].split(">")))
    dist = {}
    for sample, c, at, ids in walks:
        if sample == "ref" and c == contig:
            for i in ids:
                if at < end and at + length[i] > start:
                    dist[i] = 0
                at += length[i]
    while True:
        new = {}
        for a, d in dist.items():
            for b in near[a]:
                e = d + (0 if d == 0 else length[a]) + 1
                if e <= context and e < min(dist.get(b, 1 << 30), new.get(b, 1 << 30)):
                    new[b] = e
        if not new:
            return set(dist), walks, length
        dist |= new


@pytest.mark.parametrize("bin_bp", [16, 1 << 16])
def test_stored_loci_match_brute_force(spark, tmp_path, bin_bp):
    text = two_contigs()
    g = gfa.parse(gfa.lines_of(spark, {"graph": text})).stored()
    refs = g.walks.filter("sample = 'ref'").select("locus_id", "walk_pos", "sample", F.col("seq_id").alias("contig"))
    path = str(tmp_path / "stored")
    stored.store_graph(g, refs, path, bin_bp=bin_bp)
    for contig, start, end, context in (("c1", 1035, 1045, 0), ("c1", 1035, 1045, 15), ("c2", 1000, 1001, 40)):
        want, walks, length = brute_cut(text, contig, start, end, context)
        cut = stored.read_locus(spark, path, "ref", contig, start, end, context).stored()
        assert {r.id for r in cut.segments.collect()} == want and cut.segments.count() == len(want)
        runs = []
        for sample, c, at, ids in walks:
            run, begin = [], at
            for i in [*ids, None]:
                if i in want:
                    begin = begin if run else at
                    run.append(i)
                elif run:
                    runs.append((sample, begin, at, tuple(run)))
                    run = []
                at += length.get(i, 0)
        steps = {}
        for r in cut.steps.orderBy("walk_pos", "step_pos").collect():
            steps.setdefault(r.walk_pos, []).append(r.id)
        got = [(w.sample, w.start, w.end, tuple(steps[w.walk_pos])) for w in cut.walks.orderBy("walk_pos").collect()]
        assert got == runs
    assert stored.read_locus(spark, path, "ref", "c1", 9000, 9001).segments.count() == 0
    rows = stored.reference_nodes(spark, path, "ref", "c1", 1035, 1045)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    folders, pushed = (next(x for x in plan.split("\n") if x.startswith(k)) for k in ("PartitionFilters", "PushedFilters"))
    assert "contig" in folders and "LessThan(ref_start,1045)" in pushed and "GreaterThan(ref_end,1035)" in pushed


def test_command_line(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(two_contigs())
    where = str(tmp_path / "stored")
    args = cli.parser().parse_args(["--graph", where, "--store", str(tmp_path / "g.gfa"), *query_arguments("ref", "c1", 1030, 1050, 0, raw=True)])
    lines = [r["value"] for r in cli.run(spark, args).collect()]
    assert lines[0] == "H\tVN:Z:1.1\tRS:Z:ref" and "W\tref\t0\tc1\t1030\t1050\t>103>104" in lines and "L\t103\t+\t104\t+\t0M" in lines
    back = gfa.parse(gfa.lines_of(spark, {"x": "\n".join(lines)}))
    assert back.segments.count() == 2 and back.links.count() == 1
    spark.createDataFrame([("ref", "Own1", "c1", 1030, 1050, 0)], "ref string, symbol string, contig string, start long, end long, pos long").write.parquet(f"{tmp_path}/genes")
    reduced = cli.run(spark, cli.parser().parse_args(["--graph", where, "--sample", "ref", "--gene", "own1", "--genes", f"{tmp_path}/genes", "--context", "0"])).collect()
    assert any(r["value"].startswith("X\t") for r in reduced)
    for bad in (["--interval", "5..5"], ["--interval", "x"], ["--context", "-1"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["--graph", where, *bad])
    with pytest.raises(SystemExit):
        cli.run(spark, cli.parser().parse_args(["--graph", where]))
