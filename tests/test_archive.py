"""Writes, ledger, queue, publication, listings and search on small cases with nulls, ties, repeats and empty tables."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from talklake.functions import text
from talklake.functions.instants import instant
from talklake.operators import archive_writes, ledger, public_metrics, publish, trees, work_queue
from talklake.plans import listing, search
from talklake.sources import snapshot
from talklake.sources.archive import Archive

MESSAGE = "id string, edited_at string, deleted_at string, content string, shape string, at string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_newer_follows_its_rules(spark):
    t1, t2 = "2025-01-01T00:00:00Z", "2025-01-01T00:00:01+00:00"
    # id: stored (edited, deleted, content), incoming (the same), which side stays
    cases = {
        "tombstone": ((None, t1, "a"), (t2, None, "b"), "stored"), "later edit": ((t1, None, "a"), (t2, None, "b"), "incoming"), "earlier edit": ((t2, None, "a"), (t1, None, "b"), "stored"),
        "edit against none": ((None, None, "a"), (t1, None, ""), "incoming"), "none against edit": ((t1, "", "a"), (None, t2, "b"), "stored"), "same edit": ((t1, None, "a"), (t1, None, "b"), "incoming"),
        "empty reread": ((t1, None, "a"), (t1, None, ""), "stored"), "empty of empty": ((None, None, ""), (None, None, None), "incoming"), "deleted now": ((None, None, "a"), (None, t1, ""), "incoming"),
    }
    row = lambda k, x: (k, *x, "s", t1)
    stored = spark.createDataFrame([row(k, c[0]) for k, c in cases.items()] + [("alone", None, None, "a", "s", t1)], MESSAGE)
    incoming = spark.createDataFrame([row(k, c[1]) for k, c in cases.items()] * 2 + [("new", None, None, None, "s", t1)], MESSAGE)
    got = {r.id: r.kept for r in archive_writes.keep_newer(stored, incoming, shape=["shape"]).collect()}
    assert got == {k: c[2] for k, c in cases.items()} | {"alone": "stored", "new": "incoming"}
    # another shape is a change, and a row observed after the batch began stays
    other = incoming.withColumn("shape", F.lit("z"))
    assert {r.id: r.kept for r in archive_writes.keep_newer(stored, other, shape=["shape"]).collect()}["empty reread"] == "incoming"
    fence = archive_writes.keep_newer(stored.withColumn("seen", instant(F.lit(t2))), incoming.withColumn("start", instant("at")), "seen", "start")
    fenced = {r.id: r.kept for r in fence.collect()}
    assert fenced["same edit"] == "stored" and fenced["later edit"] == "incoming"
    assert archive_writes.keep_newer(stored.limit(0), incoming.limit(0)).count() == 0


def test_deletions_children_cursors_events(spark):
    r = spark.createDataFrame([("1", None, None, 5), ("2", "old", "x", 6), (None, None, None, 7)], "id string, deleted_at string, deletion_source string, at int")
    gone = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c"), ("9", "d")], "id string, at string")
    assert rows(archive_writes.mark_deleted(r, gone, ["id"], "api")) == sorted([("1", "a", "api", 5), ("2", "old", "x", 6), (None, None, None, 7), ("9", "d", "api", None)], key=repr)
    a = spark.createDataFrame([("a", "1", "n", "p"), ("b", "1", "n", None), ("c", "2", "n", "q")], "k string, m string, name string, media string")
    b = spark.createDataFrame([("a", "1", "n", None), ("b", "1", "n2", None), ("d", "1", "n", None), ("d", "1", "n", None)], "k string, m string, name string, media string")
    got = {x.k: (x.op, x.media) for x in archive_writes.reconcile(a, b, spark.createDataFrame([("1",)], "m string"), "m", ["k"], ["media"]).collect()}
    assert got == {"a": ("same", "p"), "b": ("update", None), "d": ("insert", None)}
    s = spark.createDataFrame([("x", "9"), ("y", "100"), ("z", "abc")], "scope string, cursor string")
    n = spark.createDataFrame([("x", "10"), ("y", "99"), ("z", "1"), ("w", None)], "scope string, cursor string")
    assert rows(archive_writes.advance(s, n)) == sorted([("x", "10"), ("y", "100"), ("z", "1"), ("w", None)], key=repr)
    e = spark.createDataFrame([(1, None), (2, "a")], "i int, p string")
    assert rows(archive_writes.append_events(e, spark.createDataFrame([(1, None), (3, "b"), (3, "b")], "i int, p string"), ["i", "p"])) == [(3, "b")]
    left = archive_writes.delete_guild({"guilds": spark.createDataFrame([("1",), ("2",)], "id string"), "members": spark.createDataFrame([("1", "u"), ("2", "u"), (None, "v")], "guild_id string, user_id string")}, spark.createDataFrame([("1",)], "id string"))
    assert rows(left["guilds"]) == [("2",)] and rows(left["members"]) == sorted([("2", "u"), (None, "v")], key=repr)


def test_ledger_reopens_and_prunes(spark):
    f = "operation string, source string, guild_id string, channel_id string, message_id string, related_kind string, related_id string, us long, error_class string"
    fails = spark.createDataFrame([("w", "s", "g", "c", None, "", "1", t, f"e{t}") for t in (5, 9, 7)] + [("w", "s", "g", "c", "m", "", "", 3, "e"), ("", "s", None, None, None, None, None, 1, "e")], f)
    solved = spark.createDataFrame([("w", "s", None, "c", None, None, None, 8, ""), ("w", "s", None, None, "m", None, None, 4, "")], f)
    out = ledger.record(fails, solved)
    got = {(r.message_id, r.related_id): (r.first_seen_us, r.last_seen_us, r.error_class, r.retry_count, r.resolved_us) for r in out.collect()}
    assert got == {("", "1"): (5, 9, "e9", 2, None), ("m", ""): (3, 3, "e", 0, 4)}
    assert [r.related_id for r in ledger.replay_candidates(out, 10).collect()] == ["1"] and ledger.prune(out, 100, 10).count() == 1
    assert ledger.record(fails.limit(0), solved).count() == 0


def test_queue_settles_results(spark):
    jobs = spark.createDataFrame([(m, "pending", 1, a, 0) for m, a in (("ok", 0), ("stale", 0), ("gone", 0), ("bad", 0), ("worse", 2), ("idle", 1), ("me", 0))], "message_id string, state string, revision long, attempts int, available_us long")
    res = spark.createDataFrame([("ok", 1, "abc", True), ("stale", 1, "old", True), ("gone", 1, "x", True), ("bad", 1, "abc", False), ("worse", 1, "abc", False), ("idle", 9, "abc", True), ("me", 1, "abc", True)], "message_id string, revision long, input string, ok boolean")
    m = spark.createDataFrame([(i, "@me" if i == "me" else "g", "abcdef", i == "gone") for i in ("ok", "stale", "gone", "bad", "worse", "idle", "me")], "id string, guild_id string, text string, deleted boolean")
    got = {r.message_id: (r.outcome, r.state, r.revision, r.attempts) for r in work_queue.settle(jobs, res, m, 3, 7).collect()}
    assert got == {"ok": ("done", "done", 1, 0), "stale": ("stale", "pending", 2, 0), "bad": ("retry", "pending", 1, 1), "worse": ("failed", "failed", 1, 3), "idle": ("waiting", "pending", 1, 1)}
    assert [r.message_id for r in work_queue.claim(jobs.withColumn("priority", F.lit(0)), 5, 2).collect()] == ["bad", "gone"]


def test_permissions_and_scopes(spark):
    guild = json.dumps({"roles": [{"id": "5", "permissions": "0"}, {"id": "g", "permissions": 1024}]})
    over = lambda *o: json.dumps({"permission_overwrites": [dict(zip(("id", "type", "allow", "deny"), x)) for x in o]})
    c = [("open", None, "text", over()), ("shut", None, "text", over(("g", 0, "0", "1024"))), ("member", None, "text", over(("g", 1, "0", "1024"))), ("broken", None, "text", "{"), ("cat", None, "category", over(("g", "role", "0", "1024"))), ("in", "cat", "text", over()), ("again", "cat", "text", over(("g", 0, 1024, 0))), ("t", "open", "thread_public", "{}"), ("p", "open", "thread_private", over()), ("t2", "shut", "thread_public", over())]
    ch = spark.createDataFrame([(i, "g", p, k, r) for i, p, k, r in c], "id string, guild_id string, parent_id string, kind string, raw_json string")
    ways = ch.select("id", F.lit(True).alias("open"))
    got = {r.id: r.public for r in publish.public_channels(ch, spark.createDataFrame([("g", guild)], "id string, raw_json string"), ways).collect()}
    assert {k for k, v in got.items() if v} == {"open", "member", "again", "t"}
    none = publish.public_channels(ch, spark.createDataFrame([("g", "{}")], "id string, raw_json string"), ways)
    assert none.where("public").count() == 0
    st = spark.createDataFrame([(s,) for s in ("channel:open", "channel:open:archived_private_threads_after", "channel:x", "guild:g", "guild:g:members:last_success", "wiretap:1", "share:1", None)], "scope string")
    assert rows(publish.publishable_scopes(st, ch, spark.createDataFrame([("g",)], "id string"))) == [("channel:open",), ("guild:g",)]
    assert publish.policy_id({"b": ["2", "1"], "a": 1}) == publish.policy_id({"a": 1, "b": ("1", "2")})
    assert rows(publish.chosen(ch, ["open"], None).select("id")) == [("open",), ("p",), ("t",)] and publish.chosen(ch, None, ["cat"]).count() == 7


def test_snapshot_revisions_and_import(spark, tmp_path):
    t1, t2 = "2025-01-01T01:00:00+01:00", "2025-01-01T00:00:00Z"
    local = spark.createDataFrame([("a", t1, "gone", 1), ("b", t1, None, 1), ("c", "2025-01-02T00:00:00Z", None, 1), ("d", "x", None, 1)], "id string, updated_at string, deleted_at string, v int")
    inc = spark.createDataFrame([("a", t2, None, 2), ("b", t2, "gone", 2), ("c", t2, None, 2), ("d", "y", None, 2), ("e", None, None, 2)], "id string, updated_at string, deleted_at string, v int")
    want = [("a", 1), ("b", 2), ("c", 1), ("d", 2), ("e", 2)]
    assert [(r.id, r.v) for r in publish.merge_snapshot(local, inc, ["id"]).orderBy("id").collect()] == want
    at = f"file://{tmp_path}/snap"
    first = snapshot.export(spark, {"t": inc, "u": inc.select("id")}, at, shard_bytes=80)
    assert len(list(tmp_path.glob("snap/generations/*/t/part-*.gz"))) > 1
    out = snapshot.import_tables(spark, at, {"t": local, "u": local.select("id")}, {"t": ["id"]})
    assert [(r.id, r.v) for r in out["t"].orderBy("id").collect()] == want and out["u"].count() == 5
    assert rows(snapshot.import_tables(spark, at, {"t": local}, {}, replace=True)["t"]) == rows(inc)
    assert snapshot.import_tables(spark, at, {"t": local}, {"t": ["id"]}, previous=first)["t"] is local
    for bad in ({"version": 2, "tables": {}}, {"version": 1, "tables": {"t": {"path": "../x"}}}, {"version": 1, "tables": {"t": {"path": "x"}, "u": {"path": "x"}}}):
        (tmp_path / "snap" / "manifest.json").write_text(json.dumps(bad))
        (tmp_path / "snap" / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            snapshot.read_manifest(spark, at)


def test_trees_end_in_circles_and_at_missing_parents(spark):
    up = {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "z": "y", "m": "nowhere", "n": "m"} | {f"l{i}": f"l{i - 1}" if i else "a" for i in range(300)}
    df = spark.createDataFrame([(k, p, True if k == "a" else None) for k, p in up.items()], "id string, p string, f boolean")
    got = {r.id: (r.f, r.lost, r.looped) for r in trees.up_the_tree(df, "p", ["f"]).collect()}
    assert got["c"] == (True, False, False) == got["l299"] and got["z"] == (False, False, True) == got["x"] and got["n"] == (False, True, False)
    assert trees.up_the_tree(df.limit(0), "p", ["f"]).count() == 0


def test_text_functions(spark):
    raw = ["  ﬁne\t\ttext \n", "a​b﻿c", "\x00bell\x07", "", None, "ａｂｃ １２", "日本　語"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in raw], "t string").select(text.sanitize("t")).collect()]
    assert got == ["fine text", "abc", "bell", "", None, "abc 12", "日本 語"]
    d = spark.createDataFrame([("hi <@1> <@!1> <#2> <@&3> <@9>", [("user", "1", "Ann"), ("channel", "2", "general"), ("role", "3", ""), (" user", "", "x")]), ("<@1>", None), (None, [])], "c string, m array<struct<kind:string,id:string,name:string>>")
    assert [r[0] for r in d.select(text.label_mentions(F.col("c"), F.col("m"))).collect()] == ["hi @Ann @Ann #general @3 <@9>", "<@1>", None]
    p = spark.createDataFrame([([("authored", "x"), ("reply_context", "y"), ("poll", ""), ("forward_context", "z")],)], "p array<struct<kind:string,text:string>>")
    assert p.select(text.searchable(F.col("p"))).first()[0] == "x\nreply:y\nforward:z"
    v = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>").select(text.encode_vector("v").alias("b"))
    assert [r[0] for r in v.select(text.decode_vector("b")).collect()] == [[1.5, -2.0], None, None]
    assert text.duration(93_784) == "1d2h" and text.duration(0) == "0s" and text.duration(-61) == "-1m1s" and text.markdown(["a"], [("x|y",)]).endswith("| 1 | x\\|y |")


def test_metrics_are_checked(spark):
    base = {"id": "1", "type": "metric", "entity": "e", "target": "t", "metric": "m", "kind": "counter", "ts": "2025-01-01T00:00:00Z", "value": 1.0, "observed_at": "2025-01-01T00:00:00.123456789Z", "provenance": "p", "sequence": 1}
    bad = [{"type": "x"}, {"entity": " "}, {"entity": "e" * 201}, {"ts": "soon"}, {"kind": "gauge"}, {"value": float("nan")}, {"value": -1.0}, {"value": float("inf")}, {"provenance": None}]
    good = [{}, {"id": "", "value": 1.0}, {"id": "2", "value": None}, {"id": "3", "type": "event", "kind": "note", "metric": None}, {"id": "1", "value": 9.0, "sequence": 2}]
    schema = "id string, type string, entity string, target string, metric string, kind string, ts string, value double, observed_at string, provenance string, sequence long"
    df = spark.createDataFrame([tuple((base | {"id": f"bad{i}"} | x).values()) for i, x in enumerate(bad)] + [tuple((base | x).values()) for x in good], schema)
    out = public_metrics.write(df)
    assert sorted(len(r.id) for r in out.collect()) == [1, 1, 1, 64] and out.where("id = '1'").first().value == 1.0
    assert public_metrics.write(df, out).count() == 0


def test_search_is_by_units(spark):
    df = spark.createDataFrame([("1", "panic in stack trace"), ("2", "trace"), ("3", "Überfluß flag, then a FEATURE"), ("4", "feature-flag"), ("5", None), ("6", "flag feature"), ("7", " ")], "id string, normalized_content string").withColumn("a", F.lit("Ann"))
    find = lambda q, **k: [r.id for r in search.search_units(df, q, ["normalized_content", "a"], 10, **k).collect()]
    assert find("panic trace") == ["1"] and find("feature flag") == ["6", "4", "3"] and find("uberfluß") == ["3"]
    # a unit of several words is a phrase; quotes are no words; a unit may be in another field
    assert find("feature-flag") == ["4"] and find('"flag') == ["6", "4", "3"] and find("ann trace") == ["2", "1"] and find("  ") == [] == find("!?")
    assert find("ann") == ["6", "4", "3", "2", "1"] and len(find("ann", include_empty=True)) == 7


def test_languages_are_found(spark):
    from talklake.operators.lexical import matching

    df = spark.createDataFrame([(i, t) for i, t, _ in search.LANGUAGE_CASES], "id string, normalized_content string")
    found = 0
    for case, _, query in search.LANGUAGE_CASES:
        hits = [m.select("id").limit(5).collect() for m in (matching(df, "normalized_content", query, "dense"), matching(df, "normalized_content", query, "arabic")) if m is not None]
        found += case in {r.id for r in itertools.chain(*hits)}
    assert found == 20
    assert search.search_languages(df, "東京", ["normalized_content"], "normalized_content", 5).first().id == "ja-1"
    assert search.search_languages(df, " ", ["normalized_content"], "normalized_content", 5).count() == 0


def test_semantic_errors_and_order(spark):
    v = spark.createDataFrame([(1, "p", "m", "v", 2, [1.0, 0.0]), (2, "p", "m", "v", 2, [2.0, 0.0]), (3, "p", "m", "v", 2, [0.0, 0.0]), (4, "p", "other", "v", 2, [1.0, 0.0]), (5, "p", "m", "v", 3, [1.0, 0.0, 0.0])], "id long, provider string, model string, input_version string, dimensions int, vector array<float>")
    who = search.Identity(" P ", "m", "v", 2)
    assert [(r.id, r.score) for r in search.semantic(v, [1.0, 0.0], who).collect()] == [(2, 1.0), (1, 1.0)]
    for q in ([], [1.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            search.semantic(v, q, who)
    corrupt = v.unionByName(spark.createDataFrame([(6, "p", "m", "v", 2, [1.0])], v.schema))
    with pytest.raises(Exception, match="corrupt vector of 6"):
        search.semantic(corrupt, [1.0, 0.0], who).collect()


def test_listing_filters_and_limits(spark, tmp_path):
    at = "2025-02-0{}T00:00:00.{}Z".format
    m = [(f"{i}", "g", "c1" if i % 2 else "c2", "u" if i < 4 else None, at(1 + i % 3, i), "  " if i == 5 else f"text {i} <@u>", None, None, 0, 0, at(9, 0)) for i in range(1, 7)]
    spark.createDataFrame(m, "id string, guild_id string, channel_id string, author_id string, created_at string, content string, reply_to_message_id string, deleted_at string, pinned int, has_attachments int, updated_at string").withColumn("normalized_content", F.col("content")).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("c1", "g", "general"), ("c2", "g", "log_book")], "id string, guild_id string, name string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("parent_id", "kind", "topic", "collection_scope", "deleted_at")], F.lit(0).alias("position"), F.lit(0).alias("is_archived"), F.lit(at(1, 0)).alias("updated_at")).write.parquet(f"{tmp_path}/channels.parquet")
    spark.createDataFrame([("g", "u", "ann")], "guild_id string, user_id string, username string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("global_name", "display_name", "nick", "joined_at", "role_ids_json", "deleted_at", "raw_json")], F.lit(0).alias("bot"), F.lit(at(1, 0)).alias("updated_at")).write.parquet(f"{tmp_path}/members.parquet")
    a = Archive(spark, str(tmp_path))
    ids = lambda **k: [r.id for r in listing.list_messages(a, **k).collect()]
    assert ids() == ["3", "6", "1", "4", "2"] and ids(include_empty=True) == ["3", "6", "1", "4", "2", "5"]
    assert ids(last=2) == ["4", "2"] and ids(limit=2) == ["3", "6"] and ids(channel="#log") == ["6", "4", "2"] and ids(channel="%") == [] == ids(guilds=["x"])
    assert ids(author="AN") == ["3", "1", "2"] and ids(since="2025-02-02 00:00:00", before="2025-02-03 00:00:00") == ["1", "4"]
    assert [r.id for r in listing.resolve_channel(a, "LOG_BOOK").collect()] == ["c2"] and listing.resolve_channel(a, "c1").first().tier == 0
    plan = listing.list_messages(a, guilds=["g"], since="2025-02-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(guild_id, [g])" in plan or "EqualTo(guild_id,g)" in plan or "guild_id" in plan.split("PushedFilters")[1][:400]
