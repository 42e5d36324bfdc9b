"""Checks, memory, alignment, state, translation and settings."""

import json

import pytest
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.normalizing import accepted, collapsed, full_width, outer_blanks, polished
from quireline.functions.text import key_tone, progress_bar, target_token, terminator, with_terminator_parts, without_terminator
from quireline.operators import checks, memory, selection
from quireline.operators.alignment import aligned
from quireline.operators.terms import sightings
from quireline.plans.extract import reused, segmented
from quireline.plans.translate import repair, stub_provider, translate
from quireline.sources import settings
from quireline.sources.documents import decode, format_of, read_documents
from quireline.sources.state import State, guarded, still_true
from quireline.streaming.ingest import stream_reuse


def one(spark, expression, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(expression.alias("x")).first().x


CHECKS = [
    ("one two three four", None, ["missing"]),
    ("one two three four", "one two three four", ["untranslated"]),
    ("a ⟦1⟧ b", "a b", ["tags"]),
    ("pay 3.5 and 7", "zahle 7", ["numbers"]),
    ("a word", "ein\r Wort", ["eol"]),
    ("a word", "- ein Wort", ["containment"]),
    ("a word", "ein\n\nWort", ["containment"]),
    ("a word", "[x]: y", ["containment"]),
    ("a word", "ein Wort", []),
    ("x" * 50, "y", ["length"]),
]


def test_check_segments(spark):
    rows = [(k, s, t, "para", "markdown", None) for k, (s, t, _) in enumerate(CHECKS)]
    df = spark.createDataFrame(rows, "id int, masked string, target string, kind string, host string, review string")
    df = df.withColumn("slots", masking.plain_slots(F.when(F.col("id") == 2, F.array(F.lit("Go"))).otherwise(F.array().cast("array<string>"))))
    for row in checks.check_segments(df, checks.Rules(lang="de")).collect():
        assert [i.rule for i in row.issues] == CHECKS[row.id][2], CHECKS[row.id]


def test_multiset_and_lexicon(spark):
    a, b = F.array(*map(F.lit, "aabc")), F.array(*map(F.lit, "abb"))
    assert spark.range(1).select(checks.multiset_minus(a, b).alias("x")).first().x == ["a", "c"]
    assert one(spark, F.size(checks.lexicon(F.col("t"), "zh-TW")), t="視頻率") == 0
    assert one(spark, F.size(checks.lexicon(F.col("t"), "zh-TW")), t="視頻率的視頻") == 1
    assert one(spark, F.size(checks.lexicon(F.col("t"), "zh-TW", {"新詞": ("x", "warn")})), t="新詞") == 1


def test_normalizing(spark):
    assert one(spark, full_width(F.col("t")), t="中文,好 (文) 。 x") == "中文，好（文）。x"
    assert one(spark, collapsed(F.col("t")), t="a   b \n  c    \nd\t\n \t\n e  ") == "a b\n  c  \nd\n\n e"
    assert one(spark, outer_blanks(F.col("s"), F.col("t")), s="  a\n", t="b ") == "  b\n"
    assert one(spark, polished(F.col("t"), "zh-TW", ["pangu"]), t="用Go寫`x中y`碼") == "用 Go 寫`x中y`碼"
    got = one(spark, accepted(F.col("m"), F.lit(None).cast(masking.SLOTS), F.col("t"), "de", ()), m="a ⟦1⟧", t=" 【1】 b ")
    assert (got.text, got.why) == ("⟦1⟧ b", None)
    assert one(spark, accepted(F.col("m"), F.lit(None).cast(masking.SLOTS), F.col("t"), "de", ()), m="a ⟦1⟧", t="b").text is None


def test_line_ends(spark):
    assert one(spark, terminator(F.col("t")), t="a\r\nb\r\n") == "\r\n"
    assert one(spark, terminator(F.col("t")), t="a\r\nb\n") == "\n"
    assert one(spark, without_terminator(F.col("t")), t="a\r\nb") == "a\nb"
    parts = F.array(F.lit("a\r"), F.lit(""), F.lit("\nb\n"), F.lit("\r"), F.lit("c"))
    assert spark.range(1).select(with_terminator_parts(parts, F.lit("\r\n")).alias("x")).first().x == ["a", "", "\r\nb\r\n", "\r", "c"]
    assert one(spark, key_tone(F.col("t")), t=" Technical ") is None
    assert one(spark, progress_bar(F.lit(1), F.lit(3)), t="").endswith(" 33%")


def test_memory(spark, tmp_path):
    path = str(tmp_path / "tm")
    rows = ['{"hash":"h","context":"para","segmentation_version":1,"source":"a","target":"old"}', "broken", '{"hash":"h"}', '{"hash":"h","context":"para","segmentation_version":1,"tone":"technical","source":"a","target":"new"}', '{"hash":"g","source":"b","target":"legacy"}']
    (tmp_path / "tm").mkdir()
    (tmp_path / "tm" / "log.jsonl").write_text("\n".join(rows))
    known = memory.latest(memory.keyed(memory.read_memory(spark, path)))
    segments = spark.createDataFrame([("h", "para", None, None, "a"), ("h", "para", None, "literary", "a"), ("g", "list", None, None, "b")], "hash string, context string, variant string, tone string, source string")
    found = {(r.hash, r.tone): (r.hit, r.hit_origin) for r in memory.lookup(segments, known).collect()}
    assert found == {("h", None): ("new", "tm"), ("h", "literary"): (None, None), ("g", None): ("legacy", "tm:legacy")}
    done = segments.withColumns({"target": F.lit("new"), "slots": F.lit(None).cast("array<string>")})
    fresh = memory.to_commit(done, known)
    assert {(r.hash, r.tone) for r in fresh.collect()} == {("h", "literary"), ("g", None)}
    memory.append(fresh, str(tmp_path / "out"))
    assert memory.read_memory(spark, str(tmp_path / "out")).count() == 2


def test_memory_keeps_the_last_append(spark, tmp_path):
    """Of three appends the last one stands, whatever their files are called; within one append the last row does."""
    for trial in range(4):
        path = str(tmp_path / f"tm{trial}")
        for n, target in enumerate(("first", "second", "third")):
            rows = [("h", f"{target} a"), ("h", target), (f"only {n}", target)]
            assert memory.append(spark.createDataFrame(rows, "hash string, target string").coalesce(1), path) == n + 1
        found = {r.hash: r.target for r in memory.latest(memory.read_memory(spark, path).select("hash", "target", "seq"), ("hash",)).collect()}
        assert found == {"h": "third", "only 0": "first", "only 1": "second", "only 2": "third"}


def test_alignment():
    assert aligned(list("abc"), list("xabc")) == [None, 0, 1, 2]
    assert aligned(list("aa"), list("aaa")) == [None, None, None]  # a run of one key that changed its length
    assert aligned(list("aa"), list("aa")) == [0, 1]
    assert aligned(list("abab"), list("abab"), budget=1) == [None] * 4
    assert aligned([], list("a")) == [None]


def test_extract_reuse(spark):
    docs = spark.createDataFrame([("d", "de", None, "text", "One is here.\nTwo `x` is here.\n"), ("m", "de", None, "markdown", "# Head\n\nTwo `x` is here.\n")], "doc_id string, lang string, tone string, format string, text string")
    segments, nodes = segmented(docs)
    assert segments.count() == 4 and nodes.count() > 4
    prior = segments.withColumns({"key": F.to_json(F.struct("hash", "context", F.lit(1).alias("version"), "variant", "tone")), "target": F.when(F.col("source").startswith("Two"), "Zwei ⟦1⟧."), "origin": F.lit("human"), "review": F.lit(None).cast("string")})
    out = {(r.doc_id, r.id): (r.outcome, r.target) for r in reused(segments, "de", prior=prior).collect()}
    assert out[("d", "s0002")] == ("carried", "Zwei ⟦1⟧.") and out[("d", "s0001")] == ("pending", None)


def stored(spark):
    rows = [("d", "de", 1, "s0001", "para", "text-line", "Hello there", None, None, None), ("d", "de", 2, "s0002", "para", "text-line", "Good day", "Guten Tag", "human", None), ("d", "de", 3, "s0003", "para", "text-line", "Bye now", "x", "agent", "held")]
    df = spark.createDataFrame(rows, "doc_id string, lang string, pos int, id string, kind string, host string, masked string, target string, origin string, review string")
    return df.withColumns({"slots": masking.plain_slots(F.array().cast("array<string>")), "originals": F.array().cast("array<string>")})


def test_selection_and_apply(spark):
    s = stored(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(selection.select(s, "draft")) == ["s0001"]
    assert ids(selection.select(s, "draft", include_all=True)) == ["s0001"]
    assert ids(selection.select(s, "draft", include_all=True, over_human=True)) == ["s0001", "s0002"]
    assert ids(selection.select(s, "polish", over_human=True)) == ["s0002"]
    named = spark.createDataFrame([("d", "s0003"), ("e", "s0001")], "doc_id string, id string")
    assert ids(selection.select(s, ids=named)) == ["s0003"]  # an id counts in its own document
    assert selection.size_of(selection.select(s, "draft")).first() == (1, len("Hello there"))
    incoming = spark.createDataFrame([("d", "s0001", "Hallo"), ("d", "s0002", "Tag"), ("d", "s0009", "x"), ("d", "s0003", " ")], "doc_id string, id string, text string")
    got = {r.id: r.outcome for r in selection.apply(s, incoming, "de", origin="llm:draft").collect()}
    assert got == {"s0001": "applied", "s0002": "refused", "s0009": "unknown", "s0003": "blank"}
    assert {r.id: r.outcome for r in selection.hold(s, incoming.select("doc_id", "id")).collect()} == {"s0001": "blank", "s0002": "applied", "s0003": "unchanged", "s0009": "unknown"}
    rows = spark.createDataFrame([('{"a":"x"}',), ('[{"id":"b","target":"y"}]',), ('{"segments":{"c":"z"}}',)], "json string")
    assert {(r.id, r.text) for r in selection.proposals(rows).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}


@pytest.mark.parametrize(
    ("reply", "expected"),
    [('{"a":"x","n":1}', {"a": "x"}), ('```json\n{"a":"x"}\n```', {"a": "x"}), ('Sure: {"a":"x"} done', {"a": "x"}), ('[{"id":"a","text":"x"}]', {"a": "x"})],
)
def test_parse_reply(spark, reply, expected):
    assert one(spark, selection.parse_reply(F.col("t")), t=reply) == expected


def test_translate_and_repair(spark, tmp_path):
    s = stored(spark)
    out = {r.id: (r.target, r.why) for r in translate(s, selection.select(s, "draft"), "de").collect()}
    assert out == {"s0001": ("[Hello there]", None)}

    def broken(system, request):
        if len(json.loads(request)) > 1:
            raise RuntimeError("no")
        return stub_provider(system, request)

    every = s.withColumn("review", F.lit(None).cast("string"))
    got = translate(every, every, "de", broken)
    assert {r.id for r in got.where("target IS NOT NULL").collect()} == {"s0001", "s0002", "s0003"}
    saved = []

    def save(df, n):
        saved.append(n)
        new = df.select("doc_id", "lang", "id", F.col("target").alias("new"))
        return s.join(new, ["doc_id", "lang", "id"], "left").withColumn("target", F.coalesce("new", "target")).drop("new")

    fixed = repair(s, checks.Rules(lang="de"), stub_provider, save)
    assert saved == [0] and fixed.where("id = 's0001'").first().target == "[Hello there]"


def stored_state(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"), wait=2.0)
    docs = spark.createDataFrame([("d", "de")], "doc_id string, lang string")
    nodes = spark.createDataFrame([("d", "de", 1, "raw", "x", None)], "doc_id string, lang string, pos int, t string, v string, seg_id string")
    state.replace(docs, nodes, stored(spark))
    return state, docs, nodes


def test_state_keeps_documents_apart(spark, tmp_path):
    state, docs, nodes = stored_state(spark, tmp_path)
    before = sorted(p.stat().st_mtime_ns for p in (tmp_path / "state" / "data").rglob("*.parquet"))
    fr = lambda df: df.withColumn("lang", F.lit("fr"))
    state.replace(fr(docs), fr(nodes), fr(stored(spark)))
    assert state.versions() == [1, 2] and state.documents().count() == 2 and state.read("segments", 1).count() == 3
    assert before == sorted(p.stat().st_mtime_ns for p in (tmp_path / "state" / "data").rglob("*.parquet"))[: len(before)]  # nothing was rewritten
    state.replace(docs, nodes, stored(spark).where("id = 's0002'"))
    assert [r.id for r in state.current("d", "de").collect()] == ["s0002"] and state.current(lang="fr").count() == 3
    assert [(r.doc_id, r.lang, [s.id for s in r.segments]) for r in state.tracked().collect()] == [("d", "de", ["s0002"]), ("d", "fr", ["s0001", "s0002", "s0003"])]
    newer = State(spark, str(tmp_path / "newer"))
    with newer.turn() as mine:
        mine.add("documents", docs.withColumn("state_version", F.lit(99)).unionByName(docs.select(F.lit("old").alias("doc_id"), "lang", F.lit(1).alias("state_version"))))
    assert newer.documents("old").count() == 1 and newer.read("documents").count() == 2
    with pytest.raises(ValueError):
        newer.documents()


def test_state_guarded_writes(spark, tmp_path):
    state, docs, nodes = stored_state(spark, tmp_path)
    rows = [("s0001", "eins", "llm:draft", None), ("s0002", "zwei", "llm:draft", None), ("s0003", "drei", "agent", "other"), ("s9", "neun", "agent", None)]
    incoming = spark.createDataFrame([("d", "de", *r) for r in rows], "doc_id string, lang string, id string, target string, origin string, expect string")
    assert {r.id: r.outcome for r in state.write_segments(incoming).collect()} == {"s0001": "written", "s0002": "refused", "s0003": "stale", "s9": "unknown"}
    now = lambda: {r.id: r for r in state.current().collect()}
    assert (now()["s0001"].target, now()["s0001"].origin) == ("eins", "llm:draft") and now()["s0002"].target == "Guten Tag" and now()["s0003"].target == "x"
    token = state.current().where("id = 's0001'").select(target_token(F.col("target")).alias("t")).first().t
    issues = spark.createDataFrame([("d", "de", "s0001", ["length: short"], token), ("d", "de", "s0003", ["tags: lost"], "another")], "doc_id string, lang string, id string, issues array<string>, token string")
    assert [r.id for r in state.write_issues(issues).collect()] == ["s0001"] and now()["s0001"].issues == ["length: short"] and now()["s0003"].issues is None
    names = spark.createDataFrame([("d", "de", i) for i in ("s0001", "s0003", "s9")], "doc_id string, lang string, id string")
    assert {r.id: r.outcome for r in state.write_review(names).collect()} == {"s0001": "applied", "s0003": "unchanged", "s9": "unknown"}
    assert now()["s0001"].review == "held" and now()["s0001"].issues == ["length: short"]  # a review touches nothing else
    assert {r.id: r.outcome for r in state.write_review(names, None).collect()} == {"s0001": "applied", "s0003": "applied", "s9": "unknown"} and now()["s0003"].review is None
    with pytest.raises(ValueError):
        state.write_review(names, "liked")
    state.write_targets(incoming.where("id = 's0001'").select("doc_id", "lang", "id", F.lit("uno").alias("target"), "origin"))
    assert now()["s0001"].target == "uno" and now()["s0001"].issues is None  # issues told of the wording that went
    state.replace(docs, nodes, stored(spark))
    assert now()["s0001"].target is None  # patches are of the document as it was
    assert {r.id: r.outcome for r in guarded(stored(spark), incoming, over_human=True).collect()}["s0002"] == "written"
    checked = issues.select("doc_id", "lang", "id", "issues", "token")
    assert still_true(stored(spark), checked).count() == 0


def test_state_writers_take_turns(spark, tmp_path):
    import threading

    state, _, _ = stored_state(spark, tmp_path)
    state.wait = 120.0
    row = lambda n, i: spark.createDataFrame([("d", "de", i, f"wording {n}", "agent", None)], "doc_id string, lang string, id string, target string, origin string, expect string")
    empty = state.current().where("id = 's0001'").select(target_token(F.col("target")).alias("t")).first().t
    won = []

    def write(n):
        out = state.write_segments(row(n, "s0001").withColumn("expect", F.lit(empty))).first().outcome
        won.append(out)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == ["stale", "stale", "written"] and state.versions() == [1, 2, 3, 4]
    with pytest.raises(RuntimeError), state.turn() as mine:
        raise RuntimeError("a writer fails")
    assert mine.number == 5 and state.versions() == [1, 2, 3, 4]
    state.wait = 0.3
    (tmp_path / "state" / "commits" / f"{5:012d}.claim").touch()
    with pytest.raises(TimeoutError):
        state.write_segments(row(9, "s0002"))


def test_project_commands(spark, tmp_path):
    """From files to stored, translated, checked, committed and rendered documents, and the status over projects."""
    from quireline.plans import project as plan

    root = tmp_path / "books" / "one"
    root.mkdir(parents=True)
    assert settings.scaffold(str(root)) == ["lx.config.json", "config/glossary.csv", "config/dnt.txt", "config/style.txt"] and settings.scaffold(str(root)) == []
    settings.write_setting(str(root / "lx.config.json"), "targets", ["de"])
    settings.write_setting(str(root / "lx.config.json"), "sources", "src")
    with pytest.raises(ValueError):
        settings.write_setting(str(root / "lx.config.json"), "batch.size", "many")
    config = settings.load_config((root / "lx.config.json").read_text())
    (root / "src").mkdir()
    (root / "src" / "a.txt").write_text("We met Anna Berg there. Then Anna Berg left us.\n\nThe end of it.\n")
    (root / "src" / "b.md").write_text("# New\n")
    docs = read_documents(spark, str(root / "src"), root=str(root)).where("source LIKE '%a.txt'")
    state = State(spark, str(root / ".lx" / "state"))
    plan.extract(state, docs, "de", config)
    doc_id = state.documents().first().doc_id
    assert [r.source for r in plan.propose_terms(state, "de", config, spark.createDataFrame([], "source string"), str(root / "config" / "glossary.csv")).collect()] == ["Anna Berg"]
    assert (root / "config" / "glossary.csv").read_text().endswith("Anna Berg,,,error\n")
    with pytest.raises(ValueError):
        plan.propose_terms(state, "de", config | {"source_lang": "fr"}, spark.createDataFrame([], "source string"))
    wording = state.current().withColumns({"target": F.concat(F.lit("DE "), "masked"), "origin": F.lit("agent")}).select("doc_id", "lang", "id", "target", "origin")
    state.write_targets(wording.where("id = 's0001'"))
    each, issues = plan.check(state, settings.rules_of(config, "de"), str(root / ".lx" / "reports"))
    assert each.first().by_rule == {"missing": 1} and state.current().where("id = 's0002'").first().issues == ["missing: no translation"]
    assert plan.commit(state, "de", str(root / "tm")) == 1 and plan.commit(state, "de", str(root / "tm")) == 2  # the second has nothing new
    assert memory.read_memory(spark, str(root / "tm")).count() == 1
    known = memory.latest(memory.keyed(memory.read_memory(spark, str(root / "tm"))))
    plan.extract(state, docs.withColumn("text", F.concat(F.lit("A first line.\n\n"), "text")), "de", config, known)
    assert {r.id: r.target for r in state.current().collect()}["s0002"].startswith("DE We met")  # carried over
    assert plan.render(state, str(root), config, "de", fallback=True) == ["i18n/de/src/a.txt"]
    assert (root / "i18n" / "de" / "src" / "a.txt").read_text().startswith("A first line.\n\nDE We met")
    bad = tmp_path / "books" / "two"
    bad.mkdir()
    (bad / "lx.config.json").write_text("{")
    one, two = plan.status(spark, str(tmp_path / "books"), scan=True)
    assert (one["documents"][0]["doc_id"], one["documents"][0]["segments"], one["documents"][0]["stale"]) == (doc_id, 3, True)
    assert [u["label"] for u in one["untracked"]] == ["src/b.md"] and one["totals"]["documents"] == 1 and one["languages"][0]["lang"] == "de"
    assert two["error"] and two["documents"] == [] and two["totals"] is None


def test_draft_and_mend(spark, tmp_path):
    """A provider's wording goes into the state; what fails a check is asked for again."""
    from quireline.plans import project as plan

    state, _, _ = stored_state(spark, tmp_path)
    config = settings.load_config('{"batch": {"size": 2}}')
    assert plan.draft(state, "de", config, stub_provider, dry_run=True).first() == (1, len("Hello there"))
    prompts = tmp_path / "prompts"

    def noted(system, request):
        prompts.write_text(system)
        return stub_provider(system, request)

    assert [(r.id, r.target) for r in plan.draft(state, "de", config, noted, style=("Stay calm.", ())).collect()] == [("s0001", "[Hello there]")]
    assert "Stay calm." in prompts.read_text() and "into de" in prompts.read_text()
    now = {r.id: (r.target, r.origin) for r in state.current().collect()}
    assert now == {"s0001": ("[Hello there]", "llm:draft"), "s0002": ("Guten Tag", "human"), "s0003": ("x", "agent")}
    lost = spark.createDataFrame([("d", "de", "s0001", "Hallo\r", "agent")], "doc_id string, lang string, id string, target string, origin string")
    state.write_targets(lost)
    mended = plan.mend(state, checks.Rules(lang="de"), config, stub_provider)
    assert mended.where("id = 's0001'").first().target == "[Hello there]" and state.current().where("id = 's0001'").first().origin == "llm:repair"


def test_shown_and_ordered(spark):
    from quireline.operators import reports, terms

    rows = spark.createDataFrame([("d", "de", f"s{k:04d}", "tags", "m") for k in range(30)], "doc_id string, lang string, seg string, rule string, message string")
    out = reports.shown(rows).collect()
    assert [r.seg for r in out] == [f"s{k:04d}" for k in range(25)] and {r.more for r in out} == {5}
    ranked = terms.ranked(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "source string, count long"))
    assert [r.source for r in ranked.collect()] == ["c", "a", "b"]
    many = spark.createDataFrame([(f"l{k:05d}",) for k in range(12_000)], "lang string")
    docs = spark.createDataFrame([("x",)], "doc_id string")
    assert reports.untracked(docs, many, spark.createDataFrame([("X", "l00007")], "doc_id string, lang string")).count() == 11_999
    assert settings.providers({"providers": {"z": {"kind": "k"}, "a": {}}})[0]["name"] == "a"
    from quireline.sources.projects import model_listing

    assert model_listing([{"id": "b"}, {"id": "a\n"}, {"id": "a", "status": "on"}, {"id": "x" * 999}, 3]) == [{"id": "a", "status": "on"}, {"id": "b", "status": None}]


def test_format_options_reach_segmentation(spark, tmp_path):
    from quireline.plans import project as plan

    config = settings.load_config('{"formats": {"text": {"paragraph_mode": "line", "chapter_patterns": ["kapitel \\\\d+$"]}}}')
    docs = spark.createDataFrame([("d", "d.txt", "text", "\n", "Kapitel 3\nOne\ntwo\n\nthree")], "doc_id string, source string, format string, eol string, text string")
    state = State(spark, str(tmp_path / "s"))
    plan.extract(state, docs, "de", config)
    assert [(r.source, r.kind) for r in state.current().orderBy("pos").collect()] == [("Kapitel 3", "heading"), ("One", "para"), ("two", "para"), ("three", "para")]


def test_provider_is_asked_once_and_waited_for(spark, tmp_path):
    """Answers are written, so each batch is asked once though they are read twice; an unavailable provider is given time."""
    from quireline.plans.translate import Unavailable, asked

    log = tmp_path / "calls"
    log.mkdir()

    def counted(system, request):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return stub_provider(system, request)

    every = stored(spark).withColumn("review", F.lit(None).cast("string"))
    out = translate(every, every, "de", counted, size=2)
    assert out.count() == 3 and out.where("target IS NOT NULL").count() == 3 and len(list(log.iterdir())) == 2

    def busy(system, request):
        raise Unavailable("later", retry_after="7")

    def noted(seconds):
        (log / f"waited-{seconds}").touch()

    row = asked(spark.createDataFrame([("d", "[]")], "doc_id string, payload string"), busy, "", retries=3, wait=noted).first()
    assert row.reply is None and row.failure == "later" and (log / "waited-7.0").exists()


def test_align_and_terms_against_plain(spark, sf_dir):
    """q48 and q45 against the same in plain Python."""
    import difflib
    from collections import Counter, defaultdict

    from quireline import queries as catalogue

    rows = catalogue.document_segments(spark, sf_dir).select("doc_id", "lang", "pos", "id", "hash", "masked").collect()
    docs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        docs[r.doc_id].append(r)
    expected = set()
    for d, old in docs.items():
        new = [r for r in old if r.pos % 5 != 2]
        a, b = [r.hash for r in old], [r.hash for r in new]
        done = {r.pos: r.pos % 3 > 0 for r in old}
        place = [None] * len(new)
        if b and len(a) * max(Counter(b).values()) <= 8_000_000:
            for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
                if n and not (len(set(b[j : j + n])) == 1 and a.count(b[j]) != b.count(b[j])):
                    place[j : j + n] = old[i : i + n]
        for r, was in zip(new, place):
            held = [o.pos for o in old if o.hash == r.hash and done[o.pos]]
            expected.add((d, r.id, (was.pos if done[was.pos] else None) if was else (held[-1] if held else None), was is None and bool(held)))
    assert {(r.doc_id, r.id, r.from_pos, r.ambiguous) for r in catalogue.queries()["q48_align"](spark, sf_dir).collect()} == expected

    from quireline.functions.values import ABBREVIATIONS, STOPWORDS

    count, inside, where = Counter(), Counter(), defaultdict(list)
    for d in sorted(docs):
        for r in docs[d]:
            if r.lang == "en":
                for term, mid in sightings(r.masked, frozenset(ABBREVIATIONS), frozenset(STOPWORDS)):
                    count[term] += 1
                    inside[term] += mid
                    if mid and f"{d}/{r.id}" not in where[term]:
                        where[term].append(f"{d}/{r.id}")
    plain = {(t, n, inside[t], " ".join(where[t][:3])) for t, n in count.items() if n >= 2 and inside[t] and t.lower() not in ("the", "and")}
    assert {tuple(r[c] for c in ("source", "count", "mid_sentence", "examples")) for r in catalogue.queries()["q45_terms"](spark, sf_dir).collect()} == plain


def test_documents(spark, tmp_path):
    assert decode("中文測試".encode("cp950"), ("utf-8", "cp950"))[1] == "cp950"
    assert decode(b"\xff\xfea\x00")[:2] == ("﻿a", "utf-16-le")
    assert decode(b"\xff", ("utf-8", "nope"))[0] is None
    assert one(spark, format_of(F.col("t")), t="a/b.MD") == "markdown" and one(spark, format_of(F.col("t"), {"nfo": "text"}), t="x.nfo") == "text"
    (tmp_path / "a.md").write_bytes(b"# A\r\nb\r\n")
    (tmp_path / "b.txt").write_bytes("日本語テスト".encode("shift_jis"))
    (tmp_path / "c.bin").write_bytes(b"x")
    rows = {r.source.rsplit("/", 1)[-1]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"].text == "# A\nb\n" and rows["a.md"].eol == "\r\n" and rows["b.txt"].encoding == "shift_jis" and rows["c.bin"].error


def test_settings(spark, tmp_path):
    config = settings.load_config('{"batch": {"size": 3}}')
    assert settings.get_value(config, "batch.size") == 3 and settings.get_value(config, "batch.context") == 1
    assert settings.get_value(settings.set_value(config, "a.b.c", 1), "a.b.c") == 1
    assert "a" not in settings.unset_value(settings.set_value(config, "a.b.c", 1), "a.b.c")
    with pytest.raises(ValueError):
        settings.set_value(config, "batch.size.x", 1)
    assert settings.route({"routing": {"draft": {"provider": "p", "model": "m"}}, "providers": {}}, "polish") == ("p", "m")
    assert settings.protected_terms("# c\nGo\nMarrowfen\n\nGo\n") == ["Marrowfen", "Go"]
    assert settings.style_sheet("# x\nCalm.\n[Ann, Miss A]\nShort.\n[Bob]\n\n") == ("Calm.", [{"names": ["Ann", "Miss A"], "notes": "Short."}])
    (tmp_path / "g.csv").write_text("source,target,forbidden,severity\n# c\ncat,Katze,Kater;Mieze,\ndog\n")
    (tmp_path / "h.csv").write_text("a,b\nSource,target\nsource,target,,warn\n")
    assert {r.source for r in settings.read_glossary(spark, str(tmp_path / "h.csv")).collect()} == {"a", "Source", "source"}  # a header is one on the first line alone
    row = settings.read_glossary(spark, str(tmp_path / "g.csv")).first()
    assert (row.source, row.target, row.forbidden, row.severity) == ("cat", "Katze", ["Kater", "Mieze"], "error")


def test_terms():
    seen = list(sightings("Then Mr. Adler's dog met Old Tom. “Good”, I said.", frozenset({"Mr"}), frozenset({"I"})))
    assert ("Adler", True) in seen and ("Old Tom", True) in seen and ("Then", False) not in [s for s in seen if s[0] == "Mr"]
    assert ("I", True) not in seen


def test_stream(spark, tmp_path):
    spark.createDataFrame([("d", "en", "Hello you.\nBye.")], "doc_id string, lang string, text string").write.parquet(str(tmp_path / "in"))
    known = memory.latest(memory.keyed(spark.createDataFrame([("x", None, 0, None, None, "a", "b", None, 1)], memory.RECORD + ", seq int")))
    stream = spark.readStream.schema("doc_id string, lang string, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run has nothing new
        stream_reuse(stream, known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_projects(tmp_path):
    from quireline.sources import projects

    (tmp_path / "a" / "b" / ".lx").mkdir(parents=True)
    (tmp_path / ".hidden" / ".lx").mkdir(parents=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "lx.config.json").write_text("{}")
    (tmp_path / "c" / "loop").symlink_to(tmp_path)
    assert projects.find_projects(str(tmp_path)) == [str(tmp_path / "a" / "b"), str(tmp_path / "c")]
    assert projects.printable_url("https://u:p@h:8/x?k=1") == "https://h:8/x?…" and projects.printable_url("https://h/x") == "https://h/x"
    assert projects.has_version_segment("http://h/v1/x") and not projects.has_version_segment("http://h/vx")
    assert projects.backoff(9) == 20.0 and projects.backoff(1, "3") == 3.0 and projects.backoff(0, "Wed, 1 Jan", lambda: 0.5) == 1.5
    assert projects.confined_path("a/b.md", str(tmp_path)) == "a/b.md"
    for bad in ("../x", "/x", "C:x", "a/../../x", "con.txt", ""):
        with pytest.raises(ValueError):
            projects.confined_path(bad, str(tmp_path))
    with pytest.raises(ValueError):
        projects.language_tag("x/y")
    file = tmp_path / "g.csv"
    file.write_bytes(b"source,target\r\na,b")
    assert projects.append_glossary(str(file), ["Ann"]) == 1 and file.read_bytes() == b"source,target\r\na,b\r\nAnn,,,error\r\n"


def test_exports(spark):
    from quireline.plans.export import checked, rendered, sentence_list, todo

    s = stored(spark)
    both = s.withColumn("target", F.when(F.col("id") == "s0002", "Guten Tag. Wie geht es?"))
    assert [(r.id, r.n, r.sentence) for r in sentence_list(both).collect()] == [("s0002", 1, "Guten Tag. "), ("s0002", 2, "Wie geht es?")]
    assert [r.sentence for r in sentence_list(s, "source").orderBy("id").collect()] == ["Hello there", "Good day", "Bye now"]
    item = json.loads(todo(s, [{"source": "hello", "target": "hallo"}]).first().item)
    assert item == {"id": "s0001", "kind": "para", "text": "Hello there", "glossary": ["hello -> hallo"]}
    report, issues = checked(s, checks.Rules(lang="de"))
    row = report.first()
    assert (row.segments, row.translated, row.errors) == (3, 2, 1) and row.by_rule["missing"] == 1 and issues.count() >= 2
    documents = spark.createDataFrame([("d", "de", "x/y.txt", "\r\n", "text")], "doc_id string, lang string, source string, eol string, format string")
    nodes = spark.createDataFrame([("d", "de", 1, "seg", None, "s0001"), ("d", "de", 2, "raw", "\n", None), ("d", "de", 3, "seg", None, "s0002")], "doc_id string, lang string, pos int, t string, v string, seg_id string")
    out = rendered(documents, nodes, s).first()
    assert (out.path, out.text, out.missing) == ("i18n/de/x/y.txt", "[untranslated s0001]\r\nGuten Tag", 1)


def test_glossary_join_finds_what_the_rule_finds(spark):
    """Terms beside digits, accents and CJK, and terms without letters or digits, as the literal rule has them."""
    from pyspark.sql import functions as F

    from quireline.operators import checks

    terms = ["of", "that", "文字", "字", "c++", "→", "→→", "2nd", "été", "new of", "% off", "🙂a"]
    texts = ["of2 off", "éthat thatx", "這是中文字句", "a C++ b", "x→y", "a →→ b", "the 2nd 22nd", "l'été", "new of3 renew of", "5% off % offer", "🙂a 🙂ab", "", "of\n文\n字"]
    pairs = spark.createDataFrame(list(enumerate(texts)), "id int, source string").withColumn("target", F.lit("-"))
    rows = spark.createDataFrame([(t, "W", ["-"], "warn") for t in terms], "source string, target string, forbidden array<string>, severity string")
    joined = sorted((r.id, r.severity, r.term) for r in checks.glossary_issues(pairs, rows).collect())
    rule = checks.glossary(F.col("source"), F.col("target"), [{"source": t, "target": "W", "forbidden": ["-"], "severity": "warn"} for t in terms])
    literal = pairs.select("id", F.inline(rule)).collect()
    told = lambda r: next(t for t in sorted(terms, key=len, reverse=True) if repr(t) in r.message)
    assert joined == sorted((r.id, r.severity, told(r)) for r in literal) and {r[2] for r in joined} == set(terms)
