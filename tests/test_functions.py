"""Scalar functions, plans and small operators on fixtures of their own."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import grams, paths, shape, text
from tessera.operators import convert, events, graph, inspect, ranking, reduce, search
from tessera.sources import files, html
from tessera.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("glob,path,want", [("*.ts", "a.ts", True), ("*.ts", "x/a.ts", False), ("**/*.ts", "x/y/a.ts", True), ("**/*.ts", "a.ts", True), ("src/{a,b}?.py", "src/b1.py", True), ("src/[!a].py", "src/a.py", False), ("a.b", "axb", False), ("d/**", "d/e/f", True)])
def test_glob(glob, path, want):
    assert bool(re.match(paths.glob_regex(glob), path)) is want


@pytest.mark.parametrize("pattern,feature", [("a(?=b)", "lookahead"), ("(?<!a)b", "lookbehind"), (r"(a)\1", "backreference"), ("a++", "possessive quantifier"), ("(?>a)", "atomic group"), ("a+b?", None), (r"\\(?x)", None)])
def test_gate(pattern, feature):
    assert search.unsupported(pattern) == feature


def test_gate_stops_a_query(spark):
    with pytest.raises(ValueError):
        search.predicate(F.col("x"), "a(?=b)")


@pytest.mark.parametrize("pattern,all_of,any_of", [("abcd", {"abc", "bcd"}, []), ("ab.cd", set(), []), ("foo.*bar", {"foo", "bar"}, []), ("foo|bar", set(), [{"foo", "bar"}]), ("foo|ba", set(), []), ("x(abc)?y", set(), []), ("(abc)+", {"abc"}, []), ("A(BC)d", {"abc", "bcd"}, []), ("", set(), [])])
def test_trigram_plan(pattern, all_of, any_of):
    plan = search.trigram_plan(pattern)
    assert plan.all_of == all_of and plan.any_of == any_of


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["ab+c", "foo|bar", "abc(de)?", "(abc|abd)x", "a{2}bc", "x.yz?w", "(fo+)bar", "[ab]cde"]), st.text("abcdefoxyzrw", max_size=30))
def test_no_match_is_lost_by_the_plan(pattern, body):
    """Whatever matches has the plan's trigrams."""
    if re.search(pattern, body):
        key, _ = grams.codes(body)
        have, plan = set(grams.strings(key)), search.trigram_plan(pattern)
        assert plan.all_of <= have and all(g & have for g in plan.any_of)


def test_trigrams_and_masks():
    key, mask = grams.codes("ABcabcd")
    got = dict(zip(grams.strings(key), mask.tolist()))
    bit = lambda c: 1 << ((ord(c) * 31) & 7)
    assert got == {"abc": bit("a") | bit("d"), "bca": bit("b"), "cab": bit("c"), "bcd": 0}
    assert len(grams.codes("ab")[0]) == len(grams.codes(None)[0]) == 0


def test_index_gives_the_results_of_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello world\nfoo(bar)"), (2, "nothing"), (3, "hello foo\nFOO(x)"), (4, ""), (5, None), (6, "é foo(é)")], "doc_id long, text string")
    index = search.postings(docs)
    for pattern in (r"foo\(", "hello|world", "o.*", "^foo"):
        scan = sorted(map(tuple, search.grep(docs, pattern).collect()))
        assert sorted(map(tuple, search.grep(docs, pattern, index=index).collect())) == scan
    folder = str(tmp_path / "index")
    search.write_index(docs, folder, buckets=4)
    assert search.read_index(spark, folder, {"foo"}, 4).select("doc_id").distinct().count() == 3
    assert search.read_index(spark, folder, buckets=4).count() == index.count()


def test_text_functions(spark):
    x = lambda c: one(spark, c)
    assert x(text.strip_ansi(F.lit("a\x1b[31mb\x1b[0mc\x1bMd"))) == "abcd"
    assert x(text.truncate_line(F.lit("abcdefghij"), 7)) == "ab…ij"
    assert x(text.normalize_indent(F.lit("\t  a b"))) == "   a b"
    assert x(text.reflow(F.lit(" a \n\t b "))) == "a b"
    assert x(text.slugify(F.lit("  Été & more! "))) == "été-more"
    assert x(text.split_camel(F.lit("getHTTPResponse_x2"))) == ["get", "http", "response"]
    assert x(text.line_of_offset(F.lit("ab\ncd"), F.lit(4))) == 2 and x(text.column_of_offset(F.lit("ab\ncd"), F.lit(4))) == 2
    assert x(text.context_snippet(F.lit("0123456789"), F.lit(4), F.lit(5), 2, 2)) == "23456"
    assert x(text.pack_trigram(F.lit("abc"))) == (97 << 16) + (98 << 8) + 99
    assert x(text.next_mask(F.lit("A"))) == 1 << ((97 * 31) & 7)
    assert x(text.lines(F.lit("a\n\nb\n"))) == ["a", "", "b"]


def test_path_functions(spark):
    x = lambda c: one(spark, c)
    for p, want in {"a/tests/b.py": True, "a/test_b.py": True, "latest.java": False, "FooTest.java": True, "b.spec.ts": True, "src/test/x.ts": False}.items():
        assert x(paths.is_test(F.lit(p))) is want, p
    assert x(paths.is_generated(F.lit("x.ts"), F.lit("a\n// DO NOT EDIT\n"))) and not x(paths.is_generated(F.lit("x.ts"), F.lit("1\n2\n3\n4\n5\ndo not edit")))
    assert x(paths.language(F.lit("a/Jenkinsfile"))) == "groovy" and x(paths.language(F.lit("b.Rmd"))) == "markdown" and x(paths.language(F.lit("noext"))) is None
    assert x(paths.ancestors(F.lit("a/b/c.ts"))) == ["a", "a/b"]
    assert abs(x(paths.proximity(F.lit("a/b/c.rs"), F.lit("a/b/d.rs"))) - 0.1) < 1e-9 and x(paths.proximity(F.lit("x.rs"), F.lit("y.rs"))) == 0
    assert len({e for v in paths.LANGUAGES.values() for e in v.split()}) == sum(len(v.split()) for v in paths.LANGUAGES.values())


@pytest.mark.parametrize("q,kind", [("how does it work", "natural_language"), ("fooBar", "identifier"), ("where is fooBar", "mixed"), ("ERR_X", "error_code"), ("src/a/b.ts", "path"), ("a.*b", "regex"), ("", "natural_language"), ("https://a.b/c", "path"), ("token retry", "natural_language"), ("TS2304", "error_code")])
def test_query_kinds(spark, q, kind):
    assert one(spark, shape.kind(F.lit(q))) == kind


def test_cosine(spark):
    c = lambda a, b: one(spark, ranking.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert abs(c([1.0, 0.0], [1.0, 1.0]) - 0.5**0.5) < 1e-12 and c([0.0, 0.0], [1.0, 1.0]) == 0 and c([1.0], [1.0, 1.0]) == 0


def test_fusion_caps_files_but_not_protected_results(spark):
    rows = [("f", f"n{i}", 0.9 - i / 10, i == 3) for i in range(4)] + [("g", "m", 0.5, False)]
    sem = spark.createDataFrame(rows, "file string, name string, rank_score double, cap_protected boolean")
    lex = spark.createDataFrame([("g", 1.0, False), ("h", 5.0, False), ("k", 9.0, True)], "file string, score double, generated boolean")
    got = [(r.file, r.name, round(r.score, 3)) for r in ranking.fuse(sem, lex, "identifier", 10).collect()]
    assert got == [("f", "n0", 0.9), ("f", "n1", 0.8), ("f", "n3", 0.6), ("g", "m", 0.55), ("h", "", 0.25), ("k", "", 0.25)]


def test_graph_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, 6), (1, 6)], "source long, target long").withColumn("file", F.lit(0)).withColumn("line", F.col("source"))
    assert {(r.node, r.depth) for r in graph.callers(e, 6, 2).collect()} == {(1, 1), (4, 1), (3, 2)}
    assert {tuple(r) for r in graph.strong_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5)}
    assert [list(r.path) for r in graph.shortest_path(e, 2, 6).collect()] == [[2, 3, 1, 6]] and graph.shortest_path(e, 6, 1).count() == 0
    tree = {tuple(r.path): r.hidden for r in graph.call_tree(e, 1, 2).collect()}
    assert tree == {(1,): 0, (1, 2): 0, (1, 6): 0, (1, 2, 3): 2}
    assert {r.truncated for r in graph.call_tree(e, 1, 2).collect()} == {False}
    assert {(tuple(r.path), r.truncated) for r in graph.call_tree(e, 1, 2, budget=1).collect()} == {((1,), True), ((1, 2), True), ((1, 2, 3), True)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r.node for r in graph.dead_nodes(nodes, e, nodes.where("node = 4")).collect()} == {1, 2, 3, 5, 7}


def test_deep_walks(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "source long, target long")
    got = {r.node: r.depth for r in graph.walk(e, spark.createDataFrame([(0,)], "node long"), None).collect()}
    assert got == {i: i for i in range(71)}


def test_zero_results_escalate(spark):
    some, lexical = (spark.createDataFrame([(f, 1.0)], "file string, score double") for f in "ab")
    assert [tuple(r) for r in ranking.escalate(some, lexical).collect()] == [("a", 1.0, False)]
    assert [tuple(r) for r in ranking.escalate(some.limit(0), lexical).collect()] == [("b", 1.0, True)]


def test_the_index_gives_what_a_scan_gives(spark, tmp_path):
    """Literals, alternatives and patterns without trigrams, and ranks, from the stored index."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["License, a\nno", "copyright b", "Copyright c\nLicense d", "lic ens", "", None, "LICENSE\nlicence license,"] * 30)], "doc_id long, text string")
    search.write_index(docs, str(tmp_path / "index"), 8)
    whole = search.read_index(spark, str(tmp_path / "index"))
    for pattern, literal, case in (("(?:License|Copyright)[ ,]", False, False), ("license", True, True), ("ce", True, False), ("l.c", False, False)):
        plan = search.trigram_plan(pattern, literal, case)
        index = search.read_index(spark, str(tmp_path / "index"), search.plan_trigrams(plan), 8)
        assert sorted(search.grep(docs, pattern, literal, case, index).collect()) == sorted(search.grep(docs, pattern, literal, case).collect())
    for query in (["lic", "ice", "cen"], ["zzz"], ["lic"], []):
        got = ranking.lexical_rank_indexed(whole, search.read_sizes(whole), query).collect()
        assert [(r.doc_id, round(r.score, 9)) for r in got] == [(r.doc_id, round(r.score, 9)) for r in ranking.lexical_rank(docs, query).collect()]


def test_dispatch(spark):
    refs = spark.createDataFrame([(1, "a/x.rs", "rust", "HttpClient", "send"), (2, "a/x.rs", "rust", "pool", "send"), (3, "a/x.rs", "rust", None, "get"), (4, "a/x.rs", "rust", "client", "send")], "ref_id long, path string, lang string, receiver string, method string")
    nodes = spark.createDataFrame([(10, "send", "HttpClient::send", "a/y.rs", "rust"), (11, "send", "Pool::send", "b/z.rs", "rust"), (12, "get", "Map::get", "a/x.rs", "rust")], "node long, short string, scoped string, path string, lang string")
    assert {tuple(r) for r in graph.dispatch_edges(refs, nodes).collect()} == {(1, 10, "type_match"), (2, 11, "name_match"), (4, 10, "name_match")}


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 4, 2), ("a", 6, 8, 3), ("a", 10, 12, 4), ("b", 3, 3, 5)], "file string, start long, end long, hash long")
    assert {tuple(r) for r in inspect.merged_intervals(rows).collect()} == {("a", 1, 8), ("a", 10, 12), ("b", 3, 3)}
    assert {r.hash for r in inspect.maximal(rows).collect()} == {1, 3, 4, 5}


def test_failures(spark):
    for line, want in {"2 failed": True, "0 failed": False, "build failed": True, "10 failures": True, "failure in step": True, "00  fail": False, "0% failed": True, "no_failure": False, "failover": False, "1 passed, 0 failed": False, "0 failed, 1 failure": True, "error: x": True, "terror": False, "no problem": False, "Traceback (most": True}.items():
        assert one(spark, reduce.fails(F.lit(line))) is want, line
    raw, small = F.lit("a\nerror: x\nb\nerror: x\nerror: y"), F.lit("error: y")
    assert one(spark, reduce.keep_failures(raw, small, F.lit(1))) == "error: y\n" + reduce.KEPT_MARK + "\nerror: x"
    assert one(spark, reduce.keep_failures(raw, small, F.lit(0))) == "error: y"


def test_class_cap_of_a_filter(spark):
    """The first 20 lines of the class stay, all others as well; a long text takes about its length (the square: 33 s)."""
    f, cap = reduce.Filter("event", strip=(r"^view",), line_max=20, cls="list", cls_pattern=r"^click"), reduce.CAPS["list"]

    def texts(*bodies):
        rows = spark.createDataFrame([(i, b, 0) for i, b in enumerate(bodies)], "id long, text string, exit_code int")
        return [r.text for r in reduce.filtered(rows, f).orderBy("id").collect()]

    def kept(body):
        lines = [x for x in body.split("\n") if x and not x.startswith("view")]
        gone = {*[i for i, x in enumerate(lines) if x.startswith("click")][cap:]}
        return "\n".join(x for i, x in enumerate(lines) if i not in gone)

    bodies = ["\n".join(f"{'click' if i % 3 < 2 else 'view' if i % 2 else 'error'} {i}" for i in range(n)) for n in (1, 28, 29, 30, 31, 32, 200)] + ["", "view 1", "error 1\nclick 2", "click 1\n" * cap, "click 1\n" * (cap + 1) + "error 2"]
    assert texts(*bodies, None) == [*map(kept, bodies), None]
    long = "\n".join(f"{'error' if i % 5 else 'click'} {i}" for i in range(40_000))
    want, began = kept(long), time.time()
    assert texts(long) == [want]
    assert time.time() - began < 12


def test_compress_with_a_custom_tool(spark):
    rows = spark.createDataFrame([(1, "mine a", "x\nx\nx\nx\nx", 0), (2, "ls | mine", "x\nx\nx\nx\nx", 0), (3, "make all", "make[1]: Entering directory 'a'\ncc\n", 0)], "id long, command string, text string, exit_code int")
    got = {r.id: (r.tool, r.text) for r in reduce.compress(rows, {"mine": lambda d: d.select("id", F.lit("short").alias("text"))}).collect()}
    assert got == {1: ("mine", "short"), 2: ("generic", "x\n... (4 more)"), 3: ("make", "cc")}


def test_markers(spark):
    rows = spark.createDataFrame([("// TODO(ann): fix it",), ("url://TODO",), ("x /* BUG later */",), ("todo",)], "line_text string")
    assert {(r.marker, r.author, r.body) for r in inspect.marker_items(rows).collect()} == {("TODO", "ann", "fix it"), ("BUG", None, "later")}


def test_watch_scan():
    found, tail = watch.scan("", 0, "abc he", "hello")
    assert not found
    found, tail = watch.scan(tail, 6, "llo hello", "hello")
    assert found == [(4, "hello"), (10, "hello")]
    assert watch.scan(tail, 15, " x", "hello")[0] == []


def test_watch_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    parts = [[("t", 0, "say he"), ("u", 0, "hello")], [("t", 1, "llo and hello")], [("t", 2, " hello")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "task_id string, seq long, chunk string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("task_id string, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = watch.run_all(watch.watch(stream, [("all", "hello", True, False), ("once", "hel+o", False, True)]), str(tmp_path / "out"))
    count = {(r.task_id, r.watch_id): r.n for r in got.groupBy("task_id", "watch_id").agg(F.count("*").alias("n")).collect()}
    assert count == {("t", "all"): 3, ("t", "once"): 1, ("u", "all"): 1, ("u", "once"): 1}
    with pytest.raises(ValueError):
        watch.watch(stream, [("a", "b", True, True)] * 9)


def test_html():
    page = "<html><head><title>t</title></head><body><nav>n</nav><h1>A <a href='#a'>¶</a></h1><p>x <b>y</b> <a href='/z'>z</a></p><ul><li>1</li><li>2</li></ul><pre>a\n b</pre><script>s</script></body></html>"
    assert html.to_markdown(page) == "# A\n\nx **y** [z](/z)\n\n- 1\n- 2\n\n```\na\n b\n```"
    assert html.to_markdown(None) == ""


def test_finding_lines(spark):
    rows = spark.createDataFrame([(1, 1, "  a “b” "), (1, 2, "c"), (2, 1, 'a "b"'), (2, 2, "c"), (3, 1, "a"), (3, 2, "c")], "file long, line long, line_text string")
    assert {tuple(r) for r in convert.find_lines(rows, ['a "b"', "c"]).collect()} == {(1, 1, 3), (2, 1, 0)}
    assert [(r.file, r.line, r.matching, r.diverges) for r in convert.nearest_miss(rows.where("file = 3"), ["a", "x"]).collect()] == [(3, 1, 1, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\ntwo\n")
    (tmp_path / "a" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "node_modules" / "y.py").write_text("z")
    found = files.walk(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a/x.py", "a/b.bin"}
    assert {r.path for r in found.where(files.is_text(F.col("content"), F.col("size"))).collect()} == {"a/x.py"}
    assert {r.path for r in files.walk(spark, str(tmp_path), ["*.py"], ["x*"]).collect()} == set()
    some, more = files.bounded(found, 1)
    assert some.count() == 1 and more


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "t")
    files.publish(spark.range(3), folder, "v1-a")
    files.publish(spark.range(5), folder, "v1-b")
    assert files.current(spark, folder, "v1").count() == 5 and files.current(spark, folder, "v2") is None


def test_latest_and_history(spark):
    rows = spark.createDataFrame([("a", i, f"s{i}") for i in range(30)] + [("b", 1, "x")], "path string, version long, state string")
    assert events.history(rows).where("path = 'a'").count() == 20
    assert {tuple(r) for r in events.as_of(rows, 4).collect()} == {("a", 4, "s4"), ("b", 1, "x")}


def test_code_search_and_rewrite(spark):
    rows = spark.createDataFrame([("a.py", "x = f(1, 2)\ny = g(f(3))\n"), ("b.py", "not python("), ("c.py", "z = f(a, a)")], "path string, text string")
    assert {(r.path, r.code) for r in convert.ast_search(rows, "f($X, $X)").collect()} == {("c.py", "f(a, a)")}
    got = {r.path: (r.text, r.n) for r in convert.ast_replace(rows, "f($$$A)", "h($$$A)").collect()}
    assert got["a.py"] == ("x = h(1, 2)\ny = g(h(3))", 2) and got["b.py"] == ("not python(", 0)
