import math
import re
from collections import defaultdict

from depsight.llm import line_dedup as L

from . import cases


def brute(docs):
    key = lambda i: L.NO_ID if i is None else i
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.split("[ \t]+", line.strip(" \t\r")) if w)
    rows = defaultdict(int)
    for _, t in docs:
        for m in {mask(line) for line in (t or "").split("\n")} - {()}:
            rows[m] += 1
    weight = defaultdict(int)
    for m, n in rows.items():
        for i, w in enumerate(m):
            weight[len(m), m[: L.LEAD], i, w] += n

    def template(m):
        own = [weight[len(m), m[: L.LEAD], i, w] for i, w in enumerate(m)]
        least = sorted(own, reverse=True)[math.ceil(L.ALIKE * len(m)) - 1]
        if len(m) < L.MIN_TOKENS or least < L.MIN_DOCS:
            return m
        return tuple(w if x >= least else None for w, x in zip(m, own))

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if mask(line):
                holders[template(mask(line))].add((key(i), t or ""))
    keeper = {m: min(d)[0] for m, d in holders.items() if len(d) >= L.MIN_DOCS}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not mask(line) or keeper.get(template(mask(line)), key(i)) == key(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def docs():
    out = cases.texts()
    for k in range(6):
        out.append((100 + k, f"Page {k} of 12 in the manual\nown line {cases.words(5, k)}\nAll rights reserved.\n\n  user u{k} did log in  today\nServed by host alpha in zone {['east', 'west'][k % 2]}"))
    return out


def test_equals_brute_force(spark):
    order = lambda rows: sorted(map(repr, rows))
    got = [tuple(r) for r in L.report(cases.frame(spark, docs())).collect()]
    assert order(got) == order(brute(docs()))
    assert sum(r[3] for r in got) > 0


def test_a_template_is_found_among_other_lines_of_its_leaf(spark):
    names = ["ann", "bob", "cy", "dee", "eve"]
    rows = [(k, f"{cases.words(9, k)}\nPosted in the category news by editor {n}") for k, n in enumerate(names)]
    rows += [(10, "Posted in the rain we walked home slowly"), (11, "Posted in the sun they ran home fast")]
    got = {r["doc_id"]: r["n_dropped"] for r in L.report(cases.frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 10: 0, 11: 0}


def test_variants_of_one_document_are_one_document(spark):
    rows = [(1, "Served by host alpha in zone east\nServed by host alpha in zone west"), (2, "Served by host alpha in zone east")]
    assert {r["n_dropped"] for r in L.report(cases.frame(spark, rows)).collect()} == {0}
    assert sorted(r["n_dropped"] for r in L.report(cases.frame(spark, [*rows, (3, "Served by host alpha in zone north")])).collect()) == [0, 1, 1]


def test_cleaned_keeps_columns(spark):
    frame = cases.frame(spark, docs())
    out = L.cleaned(frame)
    assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes)
    assert out.count() == len(docs())


def test_empty_table(spark):
    assert L.report(cases.frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = L.report(cases.frame(spark, docs()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
