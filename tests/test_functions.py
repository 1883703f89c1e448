"""Folds, text functions and sessions."""

import random

import pytest

from tidemark.functions import folds, textual
from tidemark.plans.session import QueryError, Session, bound, is_read_only
from tidemark.sources.store import Store


def test_coalesce_bounds():
    assert folds.coalesce_bounded([(0, 10), (5, 12), (15, 20), (100, 110)], 5, 1000) == [(0, 20, 3), (100, 110, 1)]
    assert folds.coalesce_bounded([(0, 10), (12, 20)], 5, 15) == [(0, 10, 1), (12, 20, 1)]
    assert folds.coalesce_bounded([(0, 10), (60, 70)], 64, 1000, factor=3) == [(0, 10, 1), (60, 70, 1)]
    with pytest.raises(ValueError):
        folds.coalesce_bounded([(0, 100)], 1, 1000, single=50)


def test_greedy_skips_and_goes_on():
    assert folds.greedy_with_skip([(5, "a"), (9, "b"), (4, "c")], 10) == ["a", "c"]


def test_rollover_and_batches():
    assert folds.rollover([4, 7, 2, 9, 1], 10) == [0, 0, 1, 1, 2]
    assert folds.bounded_batches([4, 7, 2, 9, 20, 1], 10) == [0, 1, 1, 2, 3, 4]
    assert folds.prefetch_batches([(1, 5), (1, 5), (2, 5), (3, 5)], 3, 100) == [0, 0, 0, 1]


def test_lru_against_a_list():
    r = random.Random(1)
    trace = [r.randint(0, 9) for _ in range(200)]
    cache, hits = [], 0
    for p in trace:
        if p in cache:
            hits += 1
            cache.remove(p)
        elif len(cache) == 4:
            cache.pop(0)
        cache.append(p)
    assert folds.lru(trace, 4)[0] == hits


def test_query_parser():
    p = textual.parse_query('  "red sea" div* -- plain*x ')
    assert [(u.text, u.prefix) for u in p.units] == [("red sea", False), ("div", True), ("plain*x", False)]
    assert p.expression == '"red sea" AND "div"* AND "plain*x"'
    for bad in ("", "---", "x" * 301, " ".join("abcdefghijklmnopqrstu")):
        with pytest.raises(textual.SearchError):
            textual.parse_query(bad)


def test_snippet_prefers_several_terms():
    text = "alpha " * 60 + "gamma beta alpha tail " + "word " * 100
    s = textual.snippet(text, ["alpha", "beta", "gamma"])
    assert s["before"] and s["after"] and "beta" in s["text"] and len(s["text"]) <= 300
    assert all(s["text"][a:b].lower() in ("alpha", "beta", "gamma") for a, b in s["hits"])
    assert textual.snippet("Café au lait", ["cafe"])["hits"] == [(0, 4)]
    assert textual.snippet(None, ["x"]) == {"text": "", "before": False, "after": False, "hits": []}


def test_html_text():
    html = "<html><head><title>t</title><style>a{}</style></head><body><nav>menu</nav><h1>Hi</h1><p>a<b>b</b></p>c<script>x()</script><div hidden>no</div><br>d &amp; e</body></html>"
    assert textual.html_text(html) == "Hi ab c d & e"
    assert textual.html_text(None) == "" and textual.html_text(b"<p>x</p>") == "x"


def test_bound_parameters():
    assert bound(True) == 1 and bound(2**63 - 1) == 2**63 - 1
    for bad in (2**63, float("nan"), float("inf"), object()):
        with pytest.raises(QueryError):
            bound(bad)


def test_session(spark, small):
    with Session(spark, small) as db:
        assert db.get("SELECT :a + 1 AS x", {"a": 2**62}).x == 2**62 + 1
        assert [r[0] for r in db.all("SELECT n_name FROM nation WHERE n_nationkey IN (?, ?) ORDER BY 1", [1, 2])]
        for sql, params in (("SELECT :a", {}), ("SELECT :a", {"b": 1}), ("SELECT ?", [1, 2]), ("DROP TABLE x", None), ("SELECT 1; SELECT 2", None)):
            with pytest.raises(QueryError):
                db.frame(sql, params)
        with pytest.raises(QueryError):
            db.all("SELECT * FROM nation", max_rows=5)
        assert list(db.objects("SELECT 1 AS a, 2 AS a")) == [{"a": 2}]
        assert db.stats().errors == 1
    with pytest.raises(QueryError):
        db.frame("SELECT 1")
    assert not is_read_only(spark, "INSERT INTO t SELECT 1") and is_read_only(spark, "SELECT ':x' AS a -- ?")


def test_stems():
    from tidemark.functions.stemming import stem

    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit vietnamization vietnam operator oper hopefulness hope formalize formal electrical electr goodness good revival reviv replacement replac adoption adopt activate activ effective effect probate probat rate rate cease ceas controlling control roll roll".split()
    for word, want in zip(known[::2], known[1::2]):
        assert stem(word) == want, word
    assert stem("Été") == "Été" and stem("ab") == "ab" and stem("x9s") == "x9s"


def test_query_metrics(spark, small):
    with Session(spark, small) as db:
        db.all("SELECT * FROM region")
        one = db.last
        with pytest.raises(QueryError):
            db.get("DROP TABLE x")
        assert db.last.errors == 1 and one.files == 1 and one.bytes > 0 and one.scanned == 5 and one.rows == 5
        assert db.stats().queries == 2 and db.stats().bytes == one.bytes


def test_snippet_window_is_the_best_one():
    r = random.Random(8)
    for _ in range(200):
        text = " ".join(r.choice(["lorem", "ipsum", "sea", "seas", "red", "Réd", "x"]) for _ in range(r.randint(0, 250)))
        got = textual.snippet(text, ["red", "sea"])
        hits = [(i, w) for i, w in enumerate(text.split()) if textual.fold(w) in ("red", "sea", "seas")]
        if not hits:
            assert not got["hits"]
            continue
        starts, at = [], 0
        for w in text.split():
            starts.append(at)
            at += len(w) + 1
        spans = [(starts[i], starts[i] + len(w), textual.fold(w)[:3]) for i, w in hits]

        def value(lo):
            inside = [s for s in spans if s[0] >= lo and s[1] <= lo + 300]
            return 100 * len({s[2] for s in inside}) + min(len(inside), 20) - lo / len(text)

        best = max((max(0, s[0] - 80) for s in spans), key=lambda lo: (value(lo), -lo))
        assert abs(text.find(got["text"], max(0, best - 1)) - best) <= 41 or got["text"] in text[: best + 341]


def test_lru_by_slices_is_the_whole_trace(spark):
    from tidemark.operators.iotrace import lru_cache

    r = random.Random(4)
    rows = [(k, t, r.choice([r.randint(0, 12), r.randint(0, 400)])) for k in ("a", "b") for t in range(1500)] + [("c", 1, 5)]
    d = spark.createDataFrame(rows, "kind string, clock long, page long")
    for capacity in (1, 10, 64):
        got = {x.kind: (x.hits, x.misses, x.evicted) for x in lru_cache(d, capacity).collect()}
        assert got == {k: folds.lru([p for q, _, p in rows if q == k], capacity) for k in "abc"}


def test_command_line(spark, small, tmp_path, capsys):
    from tidemark.__main__ import main

    assert main(["list"]) == 0 and "s01_full_scan" in capsys.readouterr().out.split()
    assert main(["sql", small, "SELECT n_name FROM nation ORDER BY 1 LIMIT 2"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["sql", small, "DROP TABLE nation"], spark) == 1 and main(["run", "nothing", small], spark) == 2
    assert main(["run", "s07_values", small], spark) == 0
    s = Store(spark, f"file://{tmp_path}/s", "v bigint")
    s.put(spark.createDataFrame([(1, 2)], "page long, v long"))
    s.seal()
    capsys.readouterr()
    assert main(["inspect", s.backend.path, "v bigint"], spark) == 0 and '"puts": 1' in capsys.readouterr().out
