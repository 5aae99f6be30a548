"""Small helpers: appended tables, partition sizes, footers, the order of commands and of the summary."""

import pytest

from tesserae import cli
from tesserae.operators import digest, summary
from tesserae.operators.ranges import part_sizes
from tesserae.plans import registry
from tesserae.sources import files


def test_appended_tables_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        files.append_parquet(spark.range(k, k + 2), path)
    assert files.row_counts(spark, [path]) == {path: 6}
    with pytest.raises(ValueError, match="the table has"):
        files.append_parquet(spark.range(2).selectExpr("cast(id as int) as id"), path)


def test_part_sizes(spark):
    rows = [tuple(r) for r in part_sizes(spark.range(0, 10, 1, 4)).orderBy("part").collect()]
    assert sum(r[1] for r in rows) == 10 and [r[2] for r in rows] == [sum(x[1] for x in rows[:i]) for i in range(len(rows))]


def test_commands_come_in_the_order_of_work():
    groups = next(a for a in cli.parser()._actions if a.dest == "group").choices
    assert list(groups) == ["refgenome", "reads", "alignments", "contacts", "utils"]


def test_summary_is_in_order(spark):
    found = registry.QUERIES["A19_long_summary"](spark, "/root/testdata/sf0.001").collect()
    sections = list(dict.fromkeys(r.section for r in found))
    assert sections == ["user_metadata", "reads", "read_length", "bases", "contacts", "density", "concatemer_order"]
    assert [r.level_2 for r in found if r.section == "concatemer_order" and r.level_1 == "count"] == [b[0] for b in summary.ORDER_BINS]


def test_fasta_index(spark, tmp_path):
    cli.main(["refgenome", "prepare", str(_fasta(tmp_path)), str(tmp_path / "g")])
    text = (tmp_path / "g.fa").read_bytes()
    for row in (tmp_path / "g.fa.fai").read_text().splitlines():
        name, n, at, bases, width = row.split("\t")
        assert text[int(at) : int(at) + int(n)].decode() == {"b": "ACGT", "aa": "GATC" * 30}[name] and (int(bases), int(width)) == (int(n), int(n) + 1)
    assert [r.split("\t")[0] for r in (tmp_path / "g.fa.fai").read_text().splitlines()] == ["b", "aa"]


def _fasta(tmp_path):
    (tmp_path / "s.fa").write_text(">b one\nACG\nT\n>aa\n" + "GATC\n" * 30)
    return tmp_path / "s.fa"


def test_enzymes_cut_palindromes():
    for name, (site, at) in digest.ENZYMES.items():
        assert digest.revcomp_text(site) == site and 0 <= at <= len(site), name
