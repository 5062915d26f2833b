"""Page sources: how far a walk goes, and what of it is kept."""

import json

from shelfmark.sources import media, paged


def pages_of(feeds, size=20):
    def fetch(feed, cursor):
        at = int(cursor or 0)
        return {"items": [{"media": {"code": x}} for x in feeds[feed][at : at + size]], "next_max_id": str(at + size), "more_available": at + size < len(feeds[feed])}

    return fetch


def test_a_walk_ends_where_a_page_is_known(spark):
    feeds = {"a": [f"a{i}" for i in range(1300)], "b": [f"b{i}" for i in range(45)], "none": []}
    fetch = pages_of(feeds)
    got = {r.feed: (r.pages, r.items, r.stopped, r.complete) for r in paged.walks(paged.read_feeds(spark, feeds, fetch)).collect()}
    assert got == {"a": (65, 1300, "end", True), "b": (3, 45, "end", True), "none": (1, 0, "end", True)}
    everything = lambda feed, keys: keys if feed == "a" else [k for k in keys if k != "b44"]
    got = {r.feed: (r.pages, r.stopped, r.complete) for r in paged.walks(paged.read_feeds(spark, feeds, fetch, everything)).collect()}
    assert got == {"a": (1, "known", False), "b": (1, "known", False), "none": (1, "end", True)}
    assert [r.pages for r in paged.walks(paged.read_feeds(spark, ["a"], fetch, limit=50)).collect()] == [3]


def test_items_without_codes_and_pages_without_items():
    given = [{"items": [{"code": "x"}, {}], "next_max_id": "1", "more_available": True}, {"items": [], "next_max_id": "2", "more_available": True}, {"items": [{"code": "y"}], "more_available": True}]
    rows = list(paged.walk("f", lambda feed, cursor: given[int(cursor or 0)], lambda feed, keys: []))
    assert [(r[1], len(r[2]), r[3], r[4]) for r in rows] == [(1, 2, ["x"], None), (2, 0, [], None), (3, 1, ["y"], "end")]


def test_fixtures_as_objects_lists_and_lines(spark, tmp_path):
    cases = [{"shortcode": "a", "expected_mode": "repertoire", "expected_recipes": [{"name": "Pie"}]}, {"shortcode": "b", "expected_terms": ["x"]}]
    for name, text in (("object", json.dumps({"cases": cases}, indent=1)), ("list", json.dumps(cases)), ("lines", "\n".join(map(json.dumps, cases)))):
        path = tmp_path / name
        path.write_text(text)
        rows = media.read_cases(spark, str(path), lines=name == "lines").orderBy("shortcode").collect()
        assert [(r.shortcode, r.category, r.entity_scope) for r in rows] == [("a", "non catégorisé", "minimum"), ("b", "non catégorisé", "minimum")]
    (tmp_path / "empty").write_text(json.dumps({"cases": []}))
    assert media.read_cases(spark, str(tmp_path / "empty")).count() == 0
