from collections import defaultdict

from placelink.llm import line_dedup


def plain(rows, least):
    sites, first = defaultdict(set), {}
    for doc, source, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(source)
                if doc is not None:
                    first[line.strip(" ")] = min(first.get(line.strip(" "), doc), doc)
    out = []
    for doc, _, text in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (x.strip(" ") and len(sites[x.strip(" ")]) >= least and first.get(x.strip(" ")) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_spread(spark):
    rows = [(k, f"s{k % 25}", f"own {k}\ncommon\n spaced  \n\nhalf {k % 25 // 3}\r") for k in range(120)]
    rows += [(200 + k, f"s{k}", "\n".join(f"at {n}" for n in range(25) if k < n)) for k in range(25)]
    rows += [(900, None, "common\ncommon"), (901, "s1", None), (902, "s1", ""), (None, "s2", "common\nlast"), (3, "s3", "own 3\ncommon"), (3, "s3", "own 3\ncommon")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, k int")
    for least in (3, 10, 24):
        got = sorted(map(tuple, line_dedup.report(df, least).collect()), key=str)
        assert got == plain(rows, least)
    assert line_dedup.report(df.limit(0)).count() == 0


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "x\ny", "keep")], "doc_id long, source string, text string, site string")
    assert line_dedup.remove(df).drop("_lines").first().asDict() == {"doc_id": 1, "source": "a", "text": "x\ny", "site": "keep"}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "x\ny")], "doc_id long, source string, text string")
    plan = line_dedup.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_rows_without_an_id(spark):
    rows = [(None, f"s{k % 12}", f"own line {k}\nsaid everywhere\n\nlast {k}") for k in range(400)] + [(7, "s1", "said everywhere"), (8, "s2", "said everywhere")]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(r.text for r in got if r.doc_id is None) == sorted(f"own line {k}\n\nlast {k}" for k in range(400))
    assert {(r.doc_id, r.text) for r in got if r.doc_id} == {(7, "said everywhere"), (8, "")}
