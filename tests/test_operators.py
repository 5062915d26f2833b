from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark import api
from shelfmark.operators import canonical, evidence, guards, quality, queues, resolve, search, state, views, votes
from shelfmark.sources import media


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(tuple(r) for r in df.collect())


STATE = "shortcode string, caption string, first_seen_at string, last_seen_at string, unsaved_at string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "one", "d1", "d1", "d2"), ("b", "two", "d1", "d1", None)], STATE)
    batch = spark.createDataFrame([("a", "new", "d3", 1), ("a", "newer", "d3", 2), ("c", "three", "d3", 3), (" ", "no", "d3", 4), (None, "no", "d3", 5)], "shortcode string, caption string, seen_at string, seq int")
    out = state.upsert_seen(old, batch)
    want = [("a", "newer", "d1", "d3", None), ("b", "two", "d1", "d1", None), ("c", "three", "d3", "d3", None)]
    assert rows(out, "shortcode") == want
    assert rows(state.upsert_seen(out, batch), "shortcode") == want
    assert state.upsert_counts(old, batch).first() == (1, 2)


def test_mark_absent(spark):
    old = spark.createDataFrame([("a", "", "d", "d", None), ("b", "", "d", "d", None)], STATE)
    seen = spark.createDataFrame([("a",)], "shortcode string")
    assert rows(state.mark_absent(old, seen, F.lit("now")).select("shortcode", "unsaved_at"), "shortcode") == [("a", None), ("b", "now")]
    assert state.mark_absent(old, seen, F.lit("now"), complete=False) is old
    assert state.mark_absent(old, seen.limit(0), F.lit("now")) is old


def test_replacements(spark):
    old = spark.createDataFrame([("a", "llm", "x"), ("a", "human", "y"), ("b", "llm", "z")], "shortcode string, source string, name string")
    new = spark.createDataFrame([("a", "llm", "w")], old.schema)
    assert rows(state.replace_by_origin(old, new, "shortcode", "llm")) == [("a", "human", "y"), ("a", "llm", "w"), ("b", "llm", "z")]
    assert rows(state.insert_missing(old.where("shortcode = 'b'"), old, ["shortcode"], "name")) == [("a", "llm", "x"), ("b", "llm", "z")]
    active = spark.createDataFrame([("a", "soup", True), ("a", "tart", True), ("b", "stew", True)], "shortcode string, dish string, active boolean")
    present = spark.createDataFrame([("a", "soup"), ("a", "cake")], "shortcode string, dish string")
    got = rows(state.sync_active(active, present, ["shortcode", "dish"], "shortcode"))
    assert got == [("a", "cake", True), ("a", "soup", True), ("a", "tart", False), ("b", "stew", True)]
    none_left = state.sync_active(active, present.limit(0), ["shortcode", "dish"], "shortcode", present.select("shortcode"))
    assert rows(none_left) == [("a", "soup", False), ("a", "tart", False), ("b", "stew", True)]


def test_patches_tell_unset_from_null(spark):
    cur = spark.createDataFrame([(1, "owned", "n")], "id int, status string, note string")
    f = "struct<set:boolean,value:string>"
    patches = spark.createDataFrame([(1, 1, (True, None), (False, None)), (1, 2, (False, None), (True, "m")), (2, 1, (True, "avoid"), (False, None))], f"id int, at int, status {f}, note {f}")
    now, history = state.merge_patches(cur, patches, "id", ["status", "note"], "at")
    assert rows(now, "id") == [(1, None, "m"), (2, "avoid", None)]
    assert rows(history, "id", "at") == [(1, 1, None, "n"), (1, 2, None, "m"), (2, 1, "avoid", None)]


def test_queues(spark):
    items = spark.createDataFrame([("a", 3, None, 1), ("b", 2, None, 2), ("c", 1, None, 3), ("d", 4, "x", 4)], "shortcode string, taken_at int, unsaved_at string, ingest_seq int")
    st = spark.createDataFrame([("a", "asr", "failed", 3), ("b", "asr", "failed", 2), ("c", "ocr", "failed", 9)], "shortcode string, stage string, status string, attempts int")
    assert [r.shortcode for r in queues.retry_queue(items, st, "asr").collect()] == ["b", "c"]
    done = spark.createDataFrame([("a", "p1", None), ("b", "p0", "c")], "shortcode string, prompt_sha string, context_sha string")
    stale = lambda **k: [r.shortcode for r in queues.stale_queue(items, [items], done, {"prompt_sha": "p1", "context_sha": None}, **k).collect()]
    assert stale() == ["b", "c", "d"]
    assert stale(force=True, limit=1) == ["a"]
    assert stale(only=[]) == [] and stale(only=["a", "c", "c"]) == ["c"]
    made = spark.createDataFrame([("a", "v1"), ("b", "v2")], "shortcode string, tool_version string")
    assert rows(queues.version_queue(items, made, "v2").select("shortcode")) == [("a",), ("c",), ("d",)]
    assert queues.next_page(items, made) and not queues.next_page(made, items)


def test_majority(spark):
    df = spark.createDataFrame([(1, "g", "Kamakura"), (2, "g", " Kamakura "), (3, "g", "Kanagawa"), (4, "h", ""), (5, "t", "bb"), (6, "t", "a"), (7, "u", "zz"), (8, "u", "aa")], "id int, k string, city string")
    assert rows(votes.majority(df, ["k"], "city", "id")) == [("g", "Kamakura", ["Kanagawa"]), ("t", "a", ["bb"]), ("u", "zz", ["aa"])]


def test_resolution(spark):
    c = spark.createDataFrame(
        [
            (1, "r1", "@muku.paris", None, "restaurant", "Paris", ["ramen"], True, "llm", None),
            (2, "r2", "Muku Paris", None, "restaurant", "Paris", ["bar", "ramen"], True, "llm", None),
            (3, "r2", "Muku Paris", None, "restaurant", "Lyon", [], True, "human", None),
            (4, "r3", "Old Name", None, "restaurant", None, [], True, "llm", None),
            (5, "r3", "Soup", None, "recipe", None, [], True, "llm", None),
            (6, "r1", "Nope", None, "place", None, [], False, "llm", None),
        ],
        "id int, shortcode string, name string, name_latin string, type string, city string, facets array<string>, verified boolean, source string, resolved_name string",
    )
    modes = spark.createDataFrame([("r3", "repertoire")], "shortcode string, mode string")
    aliases = spark.createDataFrame([("restaurant", "old name", "Muku Paris")], "type string, alias string, canonical_name string")
    previous = spark.createDataFrame([(7, "Muku Paris", "restaurant")], "id long, canonical_name string, type string")
    out = resolve.resolve(c, modes, aliases, previous)
    e = out["entity"].collect()
    assert [(r.id, r.canonical_name, r.city, r.members, r.facets, r.conflicts) for r in e] == [(7, "Muku Paris", "Paris", 4, ["ramen", "bar"], {"city": ["Lyon"]})]
    assert rows(out["entity_reel"]) == [(7, "r1", 1), (7, "r2", 2), (7, "r3", 4)]
    with pytest.raises(resolve.UnverifiedCandidates):
        resolve.resolve(c.withColumn("verified", F.lit(None).cast("boolean")))


def test_search(spark):
    df = spark.createDataFrame([(1, "The street_food of Été", "x"), (2, "of the market", "street"), (3, "葱油饼 pancake", None), (4, "", "")], "id int, title string, body string")
    ids = lambda q: [r.id for r in search.search(df, q, ["title", "body"], "id").collect()]
    assert ids("street") == [1, 2] and ids("title:street") == [1]
    assert ids("street NOT market") == [1] and ids("market OR pancake") == [2, 3]
    assert ids('"of the"') == [2] and ids("mark*") == [2] and ids("^the") == [1] and ids("ete") == [1]
    assert ids("NEAR(street ete, 2)") == [1] and ids("NEAR(the ete, 1)") == []
    assert ids("葱油饼") == [3] and ids("葱油") == []
    assert [r.id for r in search.search(df, " ", ["title"], "id", newest="id").collect()] == [4, 3, 2, 1]
    for bad in ("a-b", "what?", '"', "(a", "AND", "nope:x"):
        with pytest.raises(search.QuerySyntaxError):
            ids(bad)
    assert search.search_any(df, ["a-b"], ["title"], "id", 5).count() == 0
    index = search.token_table(df, "id", "title", "body")
    assert rows(search.and_ids(index, "id", ["the", "of"])) == [(1,), (2,)]


SOURCES = "shortcode string, caption string, transcript string, ocr string, frames map<string,string>"
CANDIDATE = "id int, shortcode string, name string, evidence array<struct<source:string,quote:string,match:string,location:string>>"


def test_evidence(spark):
    src = spark.createDataFrame([("r", "Dinner at Muku Paris", "we go to mukoo", "MUKU sign", {"f1": "MUKU sign", "f2": "menu"}), ("s", "Les Pertes de la Valserine", "", "", {})], SOURCES)
    cases = [
        (1, "r", "Muku Paris", [("caption", "at Muku  Paris", "literal", "")], "literal"),
        (2, "r", "Muku Paris", [("ocr", "Muku Paris", "literal", "")], "literal"),
        (3, "r", "Mukoh", [("transcript", "go to mukoo", "phonetic", "")], "phonetic"),
        (4, "r", "Mukoh", [("caption", "at Muku", "phonetic", "")], "invalid"),
        (5, "r", "Muku", [("ocr", "MUKU sign", "literal", "f9")], "literal"),
        (6, "r", "Other", [("ocr", "menu", "literal", "f2")], "invalid"),
        (7, "r", "X", [], "missing"),
        (8, "s", "Pertes de Valserine", [("caption", "nothing", "literal", "")], "variant"),
        (9, "gone", "X y", [("caption", "q", "literal", "")], "invalid"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], CANDIDATE)
    out = evidence.assess(df, src)
    assert rows(out.select("id", "status"), "id") == [(c[0], c[4]) for c in cases]
    verdicts = spark.createDataFrame([(3, False), (8, False)], "id int, verdict boolean")
    got = dict(rows(evidence.verify(out, src, verdicts).select("id", "verified")))
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False, 9: False}
    assert {r.id for r in evidence.needs_verdict(out).collect()} == {3, 8}


def test_name_decisions(spark):
    schema = "id int, name string, type string, evidence array<struct<source:string,quote:string>>, known array<string>, authority struct<name:string,canonical_name:string,confidence:double>"
    cases = [
        (1, "Muku", "restaurant", [("transcript", "muku"), ("caption", "at MUKU!")], [], None, ("resolved", "literal_priority_evidence", "Muku", 0.99)),
        (2, "Mukoo", "restaurant", [("ocr", "Muku Paris here")], ["Muku Paris", "Else"], None, ("resolved", "known_name_in_priority_evidence", "Muku Paris", 0.95)),
        (3, "Mukoo", "restaurant", [("ocr", "Muku Paris and Else")], ["Muku Paris", "Else"], None, ("abstained", "ambiguous_local_names", None, 0.0)),
        (4, "Muku", "restaurant", [("transcript", "muku")], [], None, ("abstained", "asr_only", None, 0.6)),
        (5, "Muku", "restaurant", [("transcript", "x")], [], ("maps", "MUKU Paris", 0.97), ("resolved", "authority:maps", "MUKU Paris", 0.97)),
        (6, "Muku", "restaurant", [], [], ("maps", "MUKU Paris", 0.5), ("abstained", "low_confidence_authority:maps", None, 0.5)),
        (7, "HAY HAY home shopping", "shop", [("ocr", "hay hay home shopping")], [], None, ("resolved", "repeated_brand", "HAY HAY", 0.96)),
        (8, "Nothing", "media", [], [], ("maps", "N", 0.99), ("abstained", "no_attested_canonical_name", None, 0.0)),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], schema)
    got = {r.id: tuple(r.decision) for r in canonical.decide(df).collect()}
    assert got == {c[0]: c[6] for c in cases}


def test_guards(spark):
    base = dict(name_latin=None, type="place", scale="street", city="Paris", country="France", locality="Paris 3", facets=["market", "weird"], tags=["Cosy"], confidence=90.0, context="paris 3eme, market")
    names = ["Alpha / Beta", "alpha", "12 €", "a.md", "b.py", "c/", "d.json", "Gamma"]
    df = spark.createDataFrame([dict(base, shortcode="r", ord=i, name=n) for i, n in enumerate(names)], "shortcode string, ord int, name string, name_latin string, type string, scale string, city string, country string, locality string, facets array<string>, tags array<string>, confidence double, context string")
    out = guards.guarded(df).orderBy("ord").collect()
    assert [r.name for r in out] == ["Alpha", "Beta", "Gamma"]
    first = out[0]
    assert (first.scale, first.locality, first.facets, first.tags, first.confidence) == ("site", "Paris 3", ["market"], ["cosy", "weird"], 0.9)
    assert guards.guarded(df.where("name in ('a.md', 'Gamma')")).count() == 2


def test_stored_responses(spark):
    df = spark.createDataFrame([('{"fiche": {"topic": "t"}, "discovery": {"mentions": [{"name": "a"}]}}',), ('{"topic": "u", "entities": [{"name": "b"}]}',), ("broken",)], "raw_response string")
    got = guards.stored_responses(df).select("staged", "fiche.topic", F.size("mentions"), F.size("entities"), F.size("recipes")).collect()
    assert [tuple(r) for r in got] == [(True, "t", 1, 0, 0), (False, "u", 0, 1, 0), (False, None, 0, 0, 0)]


def test_recipes_keep_untried_last(spark):
    r = spark.createDataFrame([(1, "Soup", "thai", "asian", "main", None, "T", True, 5), (2, "Tart", "french", "european", "dessert", "s%m", "T", True, 6), (3, "Gone", "x", "x", "x", "", "T", False, 7), (4, "Stew", "thai", "asian", "main", "", "T", True, 4)], "id int, dish_name string, cuisine string, cuisine_family string, course string, summary string, title string, active boolean, updated_at int")
    a = spark.createDataFrame([(1, 1, "disappointing", 1), (2, 1, "liked", 2), (3, 4, "disappointing", 3)], "attempt_id int, recipe_id int, verdict string, created_at int").select("*", *[F.lit(None).cast("string").alias(c) for c in ("rating", "note", "changes_made", "cooked_at")])
    ids = lambda **k: [x.id for x in views.ranked_recipes(r, a, **k).collect()]
    assert ids() == [1, 4, 2] and ids(verdict="untried") == [2] and ids(cuisine="ASIAN") == [1, 4] and ids(text="tar") == [2] and ids(limit=1) == [1]


def test_merged_candidates_and_review(spark):
    c = spark.createDataFrame([(1, "r", "llm", "Muku", None, "restaurant", ["a"], ["x"], None, " "), (2, "r", "human", "MUKU", None, "restaurant", ["b", "a"], [], None, "why")], "id int, shortcode string, source string, name string, name_latin string, type string, facets array<string>, tags array<string>, highlights array<string>, why_saved string")
    got = views.merged_candidates(c).first()
    assert (got.name, got.id, got.facets, got.tags, got.why_saved) == ("MUKU", 2, ["b", "a"], ["x"], "why")


def test_scorecard(spark):
    cases = spark.createDataFrame([("a", "x", "complete", "m", "", True), ("b", "x", "minimum", None, None, None)], "case string, category string, scope string, mode string, content_kind string, actionable boolean")
    expected = spark.createDataFrame([("a", 0, "Muku", ["Mukoo"], ["restaurant"]), ("a", 1, "Gone", [], []), ("b", 0, "Z", [], ["place"])], "case string, ord int, name string, aliases array<string>, types array<string>")
    actual = spark.createDataFrame([(1, "a", "mukoo!", None, "restaurant"), (2, "a", "Extra", None, "place"), (3, "b", "z", None, "shop")], "id int, case string, name string, name_latin string, type string")
    extraction = spark.createDataFrame([("a", True, "m", None, False)], "case string, ok boolean, mode string, content_kind string, actionable boolean")
    r = quality.scorecard(cases, expected, actual, extraction).first()
    assert (r.entities_expected, r.entities_found, r.type_errors, r.false_positives) == (3, 2, 1, 1)
    assert (r.mode_accuracy, r.content_kind_accuracy, r.actionable_accuracy) == (1.0, 1.0, 0.0)
    assert quality.scorecard(cases.limit(0), expected.limit(0), actual, extraction).first().recall == 1.0


def test_media(spark):
    raw = spark.createDataFrame(
        [('{"pk": 12345, "code": "ABC", "taken_at": 1721000000, "media_type": 2, "product_type": "clips", "caption": {"text": "Un reel #Été @a.b https://x.y/z 5 spots"}, "user": {"username": "someone"}, "saved_collection_ids": [1, "x", "22"]}',), ('{"code": ""}',), ('{"code": "D", "media_type": 8}',)],
        "raw_json string",
    )
    a, b = media.parse_media(raw).orderBy("shortcode").collect()
    assert (a.kind, a.url, a.media_id, a.hashtags, a.mentions, a.links, a.has_list_marker, a.collection_ids) == ("reel", "https://www.instagram.com/reel/ABC/", "12345", ["Été"], ["a.b"], ["https://x.y/z"], True, ["1", "22"])
    assert (b.kind, b.caption, b.username) == ("carousel", "", "")
    ocr = spark.createDataFrame([("r", i, t) for i, t in enumerate(["a", "a", "", "a", "b", None])], "k string, frame int, text string")
    assert [r.text for r in media.consecutive_distinct(ocr, "k", "frame", "text").orderBy("frame").collect()] == ["a", "a", "b"]
    said = spark.createDataFrame([('then {"a": "}{", "b": [1, {"c": 2}]} and {"d": 1}',), ("none",), (None,)], "t string")
    assert [r.object for r in media.first_json_object(said, "t").collect()] == ['{"a": "}{", "b": [1, {"c": 2}]}', None, None]


def test_media_outcomes(spark):
    df = spark.createDataFrame([(0, ""), (1, "Video unavailable"), (1, "HTTP Error 429"), (1, "odd")], "code int, message string")
    assert [r[0] for r in df.select(media.download_outcome(F.col("code"), F.col("message"))).collect()] == [200, 404, 401, 0]


def test_api_checks():
    assert api.checked_attempt("liked", 5, "2024-01-01")["rating"] == 5
    for bad in (lambda: api.checked_attempt("meh"), lambda: api.checked_attempt("liked", 6), lambda: api.checked_attempt("liked", 1, "2024-13-01"), lambda: api.checked_status("meh"), lambda: api.checked_status(None, 0)):
        with pytest.raises(ValueError):
            bad()
    assert views.clamp(0) == 1 and views.clamp(99) == 20


def test_stream_replays_to_the_same_state(spark, tmp_path):
    import json

    from pyspark.sql.types import StructType

    from shelfmark.streaming.ingest import apply_batch, ingest, state_table

    landed = StructType.fromDDL("shortcode string, caption string, seen_at string, seq long")
    schema = StructType.fromDDL(STATE)
    land = tmp_path / "land"
    land.mkdir()
    (land / "1.json").write_text("\n".join(json.dumps(x) for x in ({"shortcode": "a", "caption": "1", "seen_at": "d1", "seq": 1}, {"shortcode": "b", "caption": "2", "seen_at": "d1", "seq": 2})))
    base = str(tmp_path / "state")
    ingest(spark, str(land), landed, base, schema, str(tmp_path / "ck")).awaitTermination(60)
    first = rows(state_table(spark, base, schema))
    assert first == [("a", "1", "d1", "d1", None), ("b", "2", "d1", "d1", None)]
    names = lambda: {str(p.relative_to(base)) for p in Path(base).rglob("*.parquet")}
    before = names()
    apply_batch(spark, spark.read.schema(landed).json(str(land)), 0, base, schema)
    assert rows(state_table(spark, base, schema)) == first and names() == before
    # A batch that failed before its list stands is done again, whatever it left; the bucket it doesn't touch keeps its file.
    more = spark.createDataFrame([("b", "3", "d2", 3), ("", "x", "d2", 4), (None, "x", "d2", 5)], landed)
    apply_batch(spark, more, 1, base, schema)
    (Path(base) / "current" / "2").write_text("")
    (Path(base) / "current" / ".2.crc").unlink(missing_ok=True)
    assert rows(state_table(spark, base, schema, number=1)) == first
    apply_batch(spark, more, 1, base, schema)
    assert rows(state_table(spark, base, schema)) == [("a", "1", "d1", "d1", None), ("b", "3", "d1", "d2", None)]
    assert before <= names() and all(f.startswith("v000000002/") for f in names() - before)
    assert len({f.split("/")[1] for f in names() - before}) == 1
    apply_batch(spark, more.limit(0), 2, base, schema)
    assert rows(state_table(spark, base, schema)) == [("a", "1", "d1", "d1", None), ("b", "3", "d1", "d2", None)]


def test_cascades_over_cycles_and_nulls(spark):
    person = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None), (6, 5), (None, 1)], "id long, boss long")
    note = spark.createDataFrame([("a", 1, None), ("b", 6, "a"), ("c", 5, "b"), ("d", None, None), ("e", 5, "d")], "n string, of long, after string")
    tables = {"person": (person, "id"), "note": (note, "n")}
    refers = [("person", "boss", "person", "id"), ("note", "of", "person", "id"), ("note", "after", "note", "n")]
    left = lambda gone: {k: sorted(str(r[0]) for r in v.collect()) for k, v in state.cascaded_through(tables, refers, gone).items()}
    assert left({"person": person.where("id = 3").select("id")}) == {"person": ["5", "6", "None"], "note": ["d", "e"]}
    assert left({"note": note.where("n = 'd'").select("n")}) == {"person": ["1", "2", "3", "4", "5", "6", "None"], "note": ["a", "b", "c"]}
    assert left({"person": person.limit(0).select("id")}) == {"person": ["1", "2", "3", "4", "5", "6", "None"], "note": ["a", "b", "c", "d", "e"]}


def test_interrupted_on_ties(spark):
    log = spark.createDataFrame([("a", "s", "running", 1, 1), ("a", "s", "failed", 1, 2), ("b", "s", "failed", 1, 1), ("b", "s", "running", 1, 2), ("c", "s", "running", 1, 5), ("c", "t", "done", 2, 6)], "shortcode string, stage string, status string, at int, seq long")
    none = spark.createDataFrame([], "shortcode string")
    assert sorted(r.shortcode for r in state.interrupted(log, none, "s").collect()) == ["b", "c"]
    assert sorted(r.shortcode for r in state.interrupted(log.drop("seq"), none, "s").collect()) == ["c"]
    marked = state.mark_running(log.limit(0), spark.createDataFrame([("z",)], "shortcode string"), "s", F.lit(3), seq=F.lit(7).cast("long"))
    assert tuple(marked.first()) == ("z", "s", "running", 3, 7)


def test_manifest(spark):
    from shelfmark.operators import manifest

    seen = spark.createDataFrame([("r1", "a", 0, "d1")], "run_id string, shortcode string, position int, seen_at string")
    page = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("", 4)], "shortcode string, position int")
    out = manifest.observe(seen, "r1", page, F.lit("d2"))
    assert rows(out, "shortcode") == [("r1", "a", 0, "d1"), ("r1", "b", 2, "d2")]
    runs = spark.createDataFrame([("r1", "running", 1), ("r1", "done", 2), ("r2", "running", 3)], "run_id string, status string, at int")
    assert rows(manifest.finished(runs, out).select("run_id", "status", "items"), "run_id") == [("r1", "done", 2), ("r2", "running", 0)]


def test_harness(spark, tmp_path):
    import json

    from shelfmark.plans import harness

    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"shortcode": "a", "category": "food", "entity_scope": "complete", "expected_mode": "repertoire", "expected_entities": [{"name": "Muku", "type": "restaurant", "aliases": ["Muku Paris"]}]}, {"shortcode": "b", "expected_names": ["Gone"]}]))
    cases = media.read_cases(spark, str(path))
    sources = {"reel": spark.createDataFrame([("a", "x"), ("z", "y")], "shortcode string, caption string")}

    def extract(t):
        assert [r.shortcode for r in t["reel"].collect()] == ["a"]
        made = spark.createDataFrame([(1, "a", "muku paris", None, "restaurant", True, "llm"), (2, "a", "Other", None, "place", True, "llm"), (3, "a", "Gone", None, "place", True, "human")], "id int, shortcode string, name string, name_latin string, type string, verified boolean, source string")
        return {"candidate": made, "extraction": spark.createDataFrame([("a", True, "repertoire", "", None)], "shortcode string, ok boolean, mode string, content_kind string, actionable boolean")}

    out = harness.run(sources, cases, extract)
    card = out["scorecard"].first()
    assert (card.entities_expected, card.entities_found, card.false_positives, card.mode_accuracy) == (2, 1, 1, 1.0) and not quality.passed(out["scorecard"])
    assert json.loads(harness.report(out["scorecard"]))[0]["cases"] == 2 and out["entity"].count() == 3
    path.write_text(json.dumps([{"shortcode": "a"}, {"shortcode": "a"}]))
    with pytest.raises(ValueError):
        media.read_cases(spark, str(path))
    assert harness.inside("/srv/media", "a/b.mp4") and not harness.inside("/srv/media", "../x") and not harness.inside("/srv/media", "/srv/mediax/y")


def test_listings(spark):
    df = spark.createDataFrame([(1, "g", ["Été", "ete "], " b"), (2, "g", ["x", "ÉTÉ"], "a")], "id int, k string, highlights array<string>, why string")
    assert votes.first_spellings(df, ["k"], "highlights", "id").first().highlights == "Été | x"
    assert votes.ordered_union(df, ["k"], "highlights", "id").first().highlights == ["Été", "ete ", "x", "ÉTÉ"]
    assert df.agg(votes.joined_set("why").alias("w")).first().w == " b | a"
    one = spark.createDataFrame([(None, ["place"], ["x"]), ("lesson", [], ["food"]), (None, [], [])], "content_kind string, types array<string>, tags array<string>")
    assert rows(views.theme_counts(one)) == [("Food & restaurants", 1), ("Other inspiration", 1), ("Travel & places", 1)]
    text = views.dossier([("Caption", F.lit("c")), ("Audio", F.lit(" ")), ("OCR", F.lit("o"))])
    assert spark.range(1).select(text.alias("t")).first().t == "Caption:\nc\n\nOCR:\no"
    seg = spark.createDataFrame([([(0.0, " a ", -0.5), (1.0, "b", -2.0), (2.0, "c", None)],)], "s array<struct<start:double,text:string,avg_logprob:double>>")
    said = media.spoken(F.col("s"))
    assert tuple(seg.select(said["text"], said["has_speech"], quality.mean_of(F.col("s"), "avg_logprob")).first()) == ("a c", True, -1.25)


def test_combine_takes_the_last_detail(spark):
    m = spark.createDataFrame([("r", 0, "Muku", "restaurant", "caption"), ("r", 1, "Sign", "place", "ocr"), ("q", 0, "Soup", "recipe", "caption")], "shortcode string, ord int, name string, type string, source string")
    d = spark.createDataFrame([("r", 0, "muku", "Paris"), ("r", 1, "MUKU!", "Lyon")], "shortcode string, ord int, name string, city string")
    got = rows(guards.combine(m, d).select("name", "city"))
    assert got == [("Muku", "Lyon"), ("Sign", None), ("Soup", None)]
    listed = spark.createDataFrame([("q",)], "shortcode string")
    assert rows(guards.combine(m, d, listed).select("name")) == [("Muku",), ("Sign",)]
