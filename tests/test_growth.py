"""Work that must not grow faster than the input: copies are worked on once, hits are not dealt again."""

import os

from grantloom import registry
from grantloom.operators import changes, search
from grantloom.streaming import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_any_phrase_meets_by_classes(spark, monkeypatch):
    asked = [(i, p) for i in range(12) for p in (["alpha", "beta x"] if i % 2 else ["alpha", "gam"])]
    texts = ["alpha beta x", "alpha", "gamma alpha", None, "x beta"]
    docs = [(i, texts[i % 5], "alpha" if i % 10 == 3 else None) for i in range(40)]
    sizes, real = {}, search.kept

    def counted(df, name, by=None):
        out = real(df, name, by)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(search, "kept", counted)
    got = search.any_phrase(spark.createDataFrame(asked, "id long, phrase string"), spark.createDataFrame(docs, "doc_id long, a string, b string"), {"a": 1.0, "b": 2.0})
    want = {}
    for i, p in asked:
        for d, *fields in docs:
            words = " ".join(f or "" for f in fields).split()
            if all(any(w == t or len(t) >= 3 and w.startswith(t) for w in words) for t in p.split()):
                want[i, d] = want.get((i, d), 0) + 1
    assert {(r["id"], r["doc_id"]): r["n_phrases"] for r in got.collect()} == want
    assert sizes["class_pairs"] <= 2 * 6 < len(want)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_drift_is_dealt_by_call_once(spark):
    assert shuffles(registry.QUERIES["J9_version_drift"](spark, SF)) == 1


def test_drift_of_workspaces(spark):
    need, told = "requirements array<struct<requirement_id:string,title:string,necessity:string>>", "told array<struct<field:string,before:string,after:string>>"
    rows = [
        (1, 1, ["a", "b"], "d1", "OPEN", [("r", "R", "REQUIRED")], None), (1, 2, ["c"], None, "OPEN", [], None), (1, 3, ["z"], "d1", "OPEN", [("r", "R2", "CONDITIONAL"), ("s", "S", "REQUIRED")], [("status", "x", "y")]),
        (2, 1, ["e"], "d1", "OPEN", [], None), (2, 2, [], "d1", "OPEN", [], []),
    ]
    got = changes.version_drift(spark.createDataFrame(rows, f"call_id long, version_number int, workspaces array<string>, close_at string, status string, {need}, {told}"))
    plain = [("FALLBACK", "requirementAddedUnverified", None, "S"), ("FALLBACK", "requirementNecessityUnverified", "REQUIRED", "CONDITIONAL")]
    found = [(r["workspace_id"], r["source"], r["field"], r["before"], r["after"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(w, *x) for w in "ab" for x in plain] + [("c", "RECORDED", "status", "x", "y")], key=str)


def test_event_order_is_dealt_by_call_once(spark):
    assert shuffles(registry.QUERIES["I5_event_order"](spark, SF)) == 1


def test_matches_are_not_dealt_by_watch(spark):
    for name in ("I7_watch_decision", "I8_match_action", "I9_match_notifications"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        after = plan[: plan.index("intent#")]
        assert "Exchange" not in after, name


def test_a_known_version_adds_only_new_matches(spark, tmp_path):
    watch, now = spark.createDataFrame([(1, "plan", True), (2, "plan x1", True), (3, "zebra", True)], "watch_id long, intent string, enabled boolean"), lambda ids: spark.createDataFrame([(i, True, "WEAK") for i in ids], "watch_id long, enabled boolean, minimum_band string")
    schema = "call_id long, version_number int, status string, text string"
    put = lambda rows, ids, n: (spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}"), jobs.watch_matches(spark, f"{tmp_path}/in{n}", spark.read.parquet(f"{tmp_path}/in{n}").schema, f"{tmp_path}/sink", f"{tmp_path}/checkpoint{n}", watch, now(ids), ["'ELIGIBLE' as eligibility", "'COMPLETE' as finance"]))
    first = [(1, 1, "OPEN", "planet"), (1, 1, "OPEN", "planet"), (2, 1, "OPEN", "x1 plan")]
    put(first, [1, 3], 0)
    put([*first, (3, 1, "OPEN", "zebra")], [1, 2, 3], 1)
    told = [(r["watch_id"], r["call_id"]) for r in spark.read.parquet(f"{tmp_path}/sink").collect()]
    assert sorted(told) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert {r["dedupe_key"] for r in spark.read.parquet(f"{tmp_path}/sink").filter("watch_id = 3").collect()} == {"watch:3:call:3:version:1:status:MATCHED"}


def test_index_counts_slices_of_documents(spark, monkeypatch):
    rows = [(i, ["a b a", None, "", "b c"][i % 4], ["b", "", None, "c c"][i % 4]) for i in range(23)]
    monkeypatch.setattr(search, "SLICE", 5)
    docs = spark.createDataFrame(rows, "doc_id long, x string, y string").coalesce(1)
    fields = {"x": 2.0, "y": 0.5}
    got = search.index(docs, fields).select("doc_id", "term", "tf", "length")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.postings(docs, fields).select("doc_id", "term", "tf", "length").collect()))


def test_rule_graphs_are_followed_within_a_row(spark):
    from grantloom.operators import rules

    assert shuffles(registry.QUERIES["E8_rule_graph_check"](spark, SF)) <= 10
    # per call a list of (group, parent), the groups of conditions, and those of scenarios
    chain = lambda n: [(f"g{k}", f"g{k - 1}" if k else None) for k in range(n)]
    calls = [
        (chain(3), ["g2"], ["g1"]), (chain(64), ["g63"], ["g0"]), (chain(65), ["g64"], ["g0"]), ([("g0", None), ("g1", "g2"), ("g2", "g1")], ["g0"], ["g0"]), ([("g0", None), ("g1", "g0")], ["g1", "g9"], ["g0"]),
        ([("g0", None), ("g1", "g0"), ("g2", "g0")], ["g1"], ["g2"]), ([("g0", None), ("g0", "g0")], ["g0"], ["g0"]), ([], ["g0"], ["g0"]), (chain(2), ["g1"] * 129, ["g0"]), (chain(2), ["g1"], [None]), (chain(2), ["g0"], ["g0"]), ([("g0", None), (None, "g0")], ["g0"], ["g0"]),
    ]
    put = lambda rows, schema: spark.createDataFrame(rows, schema)
    versions, sets = put([(i, True) for i in range(len(calls))], "call_id long, verified boolean"), put([(i, -i, True, True) for i in range(len(calls))], "call_id long, rule_set long, complete boolean, verified boolean")
    groups = put([(-i, g, up, "AND") for i, (gs, _, _) in enumerate(calls) for g, up in gs], "rule_set long, group_id string, parent_id string, kind string")
    conditions = put([(-i, g, True) for i, (_, cs, _) in enumerate(calls) for g in cs], "rule_set long, group_id string, trusted boolean")
    offers = put([(i, g, True) for i, (_, _, os) in enumerate(calls) for g in os], "call_id long, group_id string, trusted boolean")
    got = {r["call_id"]: r["code"] for r in rules.graph_check(versions, sets, groups, conditions, offers).collect()}
    good, over, part = "VERSION_BOUND_EVIDENCE_REFERENCES_ONLY", "SNAPSHOT_LIMIT_EXCEEDED", "INCOMPLETE_RULE_GRAPH"
    assert [got[i] for i in range(len(calls))] == [good, good, over, "INVALID_RULE_GRAPH", "UNVERIFIED_OFFICIAL_EVIDENCE", part, part, part, over, part, "UNSUPPORTED_RULE_GRAPH", part]


def test_pages_are_dealt_before_they_are_read(spark):
    """However few files they lie in; and nothing is grouped again. A row is a page of its own."""
    from grantloom.sources import pages

    pairs = registry.QUERIES["A7_html_pairs"](spark, SF)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert shuffles(pairs) == 1 and plan.index("MapInArrow") < plan.index("Exchange ")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "<table><tr><td>A::</td><td>1</td></tr><tr><td>a:</td><td>2</td><td>x</td></tr><tr><td>:</td><td>3</td></tr><tr><td>b</td><td>4</td></tr><tr><td></td><td>5</td></tr><tr><td>one</td></tr></table>"
    rows = [(1, table), (1, f"<dl><dt>B</dt><dd></dd></dl>{table}<dl><dt>A</dt><dd>6</dd></dl>"), (2, None), (3, "<p>none"), (None, "<dl><dt>k:</dt><dd>v</dd></dl>")]
    got = pages.html_pairs(spark.createDataFrame([(i, None, html) for i, html in rows], "page_id long, url string, html string").coalesce(1))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "2"), (1, "b", "4"), (1, "a", "6"), (1, "b", ""), (None, "k", "v")], key=str)


def test_pages_made_alike_are_arranged_once(monkeypatch):
    from grantloom.sources import pages

    calls = []
    monkeypatch.setattr(pages, "arranged_once", pages.lru_cache(2)(lambda names: calls.append(names) or pages.arranged(names)))
    html = lambda k: f"<h2 id={k}>n{k}</h2><div><p>a &amp; <b>{k}</b><script>'<p>'</script><svg><p>no</svg> z<table><tr><td>k{k}:</td><td> </td></tr></table><a href=/{k}>go</a>"
    for k in range(9):
        assert [x[:6] for x in pages.page_blocks("http://h.example/", html(k))] == [
            ("HEADING", f"n{k}", "html.heading.1", ["", f"n{k}"], 2, None), ("TABLE", f"k{k}: | ", "html.table.1", ["", f"n{k}"], None, None), ("LINK", "go", "html.link.1", ["", f"n{k}"], None, f"http://h.example/{k}"), ("PARAGRAPH", f"a & {k} z k{k}: go", "html.p.1", ["", f"n{k}"], None, None),
        ]
    assert len(calls) == 1
    pages.page_blocks("", "<p>x" * pages.LONGEST)
    assert len(calls) == 1


def test_history_is_read_with_its_page(spark):
    from grantloom.sources import pages

    plan = registry.QUERIES["A7_html_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange ") == 1
    table = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
    rows = [(1, f"{table('ab')}<h2>H</h2>{table('cd', 'e', 'fgh')}<h3>H</h3>{table('ij', 'kl')}<h3>x</h3>{table('mn')}"), (1, f"<h1>H</h1>{table('op')}"), (2, None), (None, f"<h1>H</h1>{table('qr')}")]
    got = pages.html_history(spark.createDataFrame([(i, None, html) for i, html in rows], "page_id long, url string, html string").coalesce(1), "H", 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "c", "d"), (1, 2, "f", "g"), (1, 3, "i", "j"), (1, 1, "o", "p"), (None, 1, "q", "r")], key=str)


def test_blocks_of_wanted_columns(spark):
    from grantloom.sources import pages

    plan = registry.QUERIES["A6_built_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "cells" not in plan and plan.index("MapInArrow") < plan.index("Exchange ")
    df = spark.createDataFrame([(1, "http://h.example/", "<h1>a</h1><p>b <a href=c>d</a></p><dl><dt>e</dt><dd>f</dd></dl>"), (2, None, None)], "page_id long, url string, html string")
    everything = pages.html_blocks(df)
    assert everything.columns == ["page_id", "pos", "kind", "text", "locator", "section", "heading_level", "link_url", "cells"] and everything.count() == 4
    for some in (["kind"], ["section", "link_url"], ["cells", "pos"], ["heading_level", "locator", "text"]):
        got = pages.html_blocks(df, *some)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, everything.select(got.columns).collect()), key=str) and set(got.columns) == {"page_id", *some}


def test_pairs_are_unpacked_after_all_joins(spark, monkeypatch):
    """Whatever the sizes of packs; one class of documents is dealt by pack."""
    monkeypatch.setattr(search, "DOCS", 3)
    monkeypatch.setattr(search, "ASKED", 2)
    asked = [(i, p) for i in range(7) for p in (["alpha"] if i < 5 else ["beta", "alpha"])]
    texts = {d: "alpha" if d < 10 else "beta alpha" if d < 14 else "none" for d in range(16)}
    got = search.any_phrase(spark.createDataFrame(asked, "id long, phrase string"), spark.createDataFrame(list(texts.items()), "doc_id long, a string"), {"a": 1.0})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.rindex("Generate explode") < plan.index("Join")
    want = {(i, d, n) for i in range(7) for d, text in texts.items() if (n := sum(p in text.split() for p in (["alpha"] if i < 5 else ["beta", "alpha"])))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_rules_are_checked_where_their_rows_lie(spark, monkeypatch):
    """Rules of one row, of a key and of a reference within the first column of a key shuffle nothing, beside the
    one shuffle of what is cached; and nothing stays cached."""
    from grantloom.operators import constraints
    from grantloom.plans import upkeep

    plans, real = [], upkeep.kept

    def looked_at(df, name, **options):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "lineitem" not in plan or ", 6), REPARTITION_BY_NUM" in plan  # 6,000 lines
        plans.append((plan.count("ENSURE_REQUIREMENTS"), plan.count("REPARTITION_BY_NUM")))
        return real(df, name, **options)

    monkeypatch.setattr(upkeep, "kept", looked_at)
    monkeypatch.setattr(upkeep, "LINES", 1000)
    got = registry.QUERIES["E12_constraints"](spark, SF)
    order = [[*c.checks, *c.unique, *c.references, *c.one_root][0] for t in ("funded", "requirements", "version_documents", "rule_groups", "verified_conditions", "watches") for c in constraints.apart(upkeep.DECLARED[t])]
    found = dict(zip(order, plans, strict=True))
    for rule in ("NECESSITY", "ONE_TITLE", "DIGEST_REQUIRED", "KIND", "GROUP_ID", "ONE_ROOT", "PARENT", "EVIDENCE"):
        assert found[rule][0] == 0 and found[rule][1] > 0, (rule, found)
    assert shuffles(got) == 0 and spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
