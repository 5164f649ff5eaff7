from collections import defaultdict

import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import linespread  # noqa: E402

SCHEMA = "doc_id long, text string, source string, n_lines string, other int"
BOILER = "All rights reserved by the owner."


def brute(rows, least, min_chars):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" ")
            if len(line) >= min_chars:
                sites[line] |= {source} - {None}
                texts[line].add(text)
    gone = {x for x in sites if len(sites[x]) >= least and len(texts[x]) > 1}
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" ") not in gone]
        if not any(x.strip(" ") for x in kept):
            kept = lines
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows_of(sites):
    rows = [(i, f"Own line number {i} of the text.\n {BOILER} \nshort\n\nline of {i % 9} shared texts here", f"s{i % sites}", "old", 1) for i in range(sites * 6)]
    rows += [(9000 + i, "A copied page line one.\nA copied page line two.", f"s{i}", "old", 1) for i in range(sites)]
    rows += [(9500, BOILER, "s1", None, None), (9501, BOILER + "\n\n", "s2", None, None), (9502, None, "s1", None, None), (9503, "", None, None, None), (9504, f"{BOILER}\nmine, all mine, this line", None, None, None)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("sites", [4, 7, 8, 9, 12])
@pytest.mark.parametrize("inline", [5000, 0])
def test_against_brute_force(spark, sites, inline):
    rows = rows_of(sites)
    df = spark.createDataFrame(rows, SCHEMA)
    found = linespread.remove_boilerplate(df, inline=inline)
    assert found.columns == ["doc_id", "text", "source", "other", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect() if r.text is not None) == sorted(x for x in brute(rows, 8, 16) if x[1] is not None)
    assert [(r.n_lines, r.n_removed) for r in found.collect() if r.text is None] == [(0, 0)]


def test_copies_of_one_text_are_no_boilerplate(spark):
    rows = [(i, "A page line one is here.\nA page line two is here.", f"s{i}", None, None) for i in range(30)]
    assert linespread.boilerplate(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * n + i, f"line of {n} sites, as it is\nand {i} of its own", f"s{i}", None, None) for n in range(1, 40) for i in range(n)]
    assert linespread.boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=20).count() == 20


def test_spread_is_of_sites_and_needs_two_texts(spark):
    """A line on many sites in few texts goes; one on few sites in many texts, or in one text alone, stays."""
    rows = [(i, f"On ten sites, in two texts only.\nown {i % 2}", f"s{i}", None, None) for i in range(10)]
    rows += [(100 + i, f"On seven sites, in many texts here.\nown {i}", f"s{i % 7}", None, None) for i in range(40)]
    rows += [(200 + i, "On all of the sites, in one text.\nand so is this one", f"s{i}", None, None) for i in range(20)]
    rows += [(300, "On ten sites, in two texts only.\n" + "a long line of words \n" * 30_000, "s1", None, None)]
    found = {r.doc_id: r for r in linespread.remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i].text == f"own {i % 2}" and found[i].n_removed == 1 for i in range(10))
    assert not any(found[i].n_removed for i in [*range(100, 140), *range(200, 220)])
    assert found[300].n_removed == 1 and found[300].n_lines == 30_002


@pytest.mark.parametrize("inline", [5000, 0])
def test_hot_texts_and_nulls(spark, inline):
    rows = [(i, f"All over the place, this line.\nown {i % 3}", f"s{i % 12}", None, None) for i in range(600)] + [(1000 + i, None, "s1", None, None) for i in range(300)]
    found = linespread.remove_boilerplate(spark.createDataFrame(rows, SCHEMA), inline=inline).collect()
    assert len(found) == 900 and sum(r.n_removed for r in found) == 600 and sum(r.text is None for r in found) == 300


def test_empty_table(spark):
    assert linespread.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
