import random

import pytest

from lociforge.sources import fasta, indexed_fasta

from helpers import intervals_df


def genome(tmp_path, name="g.fa", newline="\n", final=True, width=7):
    draw = random.Random(3)
    contigs = {c: "".join(draw.choice("ACGTacgtN") for _ in range(n)) for c, n in
               [("chr1", 503), ("chr2", 7), ("chr3", 5), ("chr4", 0), ("chr5", 140)]}
    lines = []
    for contig, bases in contigs.items():
        lines.append(f">{contig} some words")
        lines += [bases[i:i + width] for i in range(0, len(bases), width)]
    path = tmp_path / name
    path.write_bytes((newline.join(lines) + (newline if final else "")).encode())
    return str(path), contigs


@pytest.mark.parametrize("newline, final, split", [("\n", True, 64), ("\r\n", True, 50), ("\n", False, 1000), ("\n", True, 11)])
def test_index_and_fragments(spark, tmp_path, newline, final, split):
    path, contigs = genome(tmp_path, newline=newline, final=final)
    index = indexed_fasta.index_of(spark, path, split, normalize=False)
    rows = {r.contig: r for r in index.collect()}
    assert {c: r.length for c, r in rows.items()} == {c: len(b) for c, b in contigs.items()}
    assert all(r.uniform for r in rows.values())
    data = open(path, "rb").read()
    assert all(data[rows[c].offset:rows[c].offset + 1].decode() == b[0] for c, b in contigs.items() if b)
    found = {(r.contig, r.frag_start): bytes(r.bases).decode() for r in indexed_fasta.fragments_at(index, length=30).collect()}
    assert found == {(c, i): b[i:i + 30].upper() for c, b in contigs.items() for i in range(0, len(b), 30)}
    if newline == "\n":
        whole = {(r.contig, r.frag_start): bytes(r.bases).decode() for r in fasta.fragment(fasta.read_lines(spark, path, normalize=False), 30).collect()}
        assert found == whole


def test_only_the_bytes_of_the_loci(spark, tmp_path):
    path, contigs = genome(tmp_path)
    index = indexed_fasta.index_of(spark, path, normalize=False)
    loci = intervals_df(spark, [("chr1", 61, 62), ("chr1", 89, 91), ("chr1", 70, 75), ("chr5", 139, 400), ("chrX", 0, 9), ("chr2", 50, 60), ("chr1", 9, 9)])
    ranges = indexed_fasta.byte_ranges(index, loci, 30).collect()
    assert sorted((r.contig, r.frag_start) for r in ranges) == [("chr1", 60), ("chr1", 90), ("chr5", 120)]
    assert sum(r.until - r.since for r in ranges) <= 3 * (30 + 30 // 7 + 1)
    found = indexed_fasta.fragments_at(index, loci, 30)
    assert {(r.contig, r.frag_start): bytes(r.bases).decode() for r in found.collect()} == {
        (c, i): contigs[c][i:i + 30].upper() for c, i in [("chr1", 60), ("chr1", 90), ("chr5", 120)]}
    assert fasta.fragment_length(found) == 30


def test_uneven_lines_are_noticed(spark, tmp_path):
    path = tmp_path / "odd.fa"
    path.write_text("ACGT\n>a\nACGT\nAC\nACGT\n>b\nAC\nAC\n>c\nAC\nACG\n>e\n")
    rows = {r.contig: (r.length, r.uniform) for r in indexed_fasta.index_of(spark, str(path), 5, normalize=False).collect()}
    assert rows["a"] == (10, False) and rows["b"] == (4, True) and rows["c"][1] is False and rows["e"] == (0, True)
    with pytest.raises(Exception, match="different length in contig"):
        indexed_fasta.fragments_at(indexed_fasta.index_of(spark, str(path), normalize=False)).collect()
    (tmp_path / "none.fa").write_text("")
    assert indexed_fasta.index_of(spark, str(tmp_path / "none.fa")).count() == 0
