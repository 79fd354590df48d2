"""What a review found: results on whole tables, and steps that grew faster than their input."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from docweave import registry, tables
from docweave.functions import detection
from docweave.llm import simhash
from docweave.operators import fulltext, similarity, vector_index
from docweave.plans import lifecycle
from docweave.plans.analytics import STATEMENTS
from docweave.scratch import saved
from docweave.sources import corpus, html
from docweave.streaming import ingest, state


def test_cut_references_are_text():
    got = html.markdown("<h1>a &amp</h1><p>b &amp; c &lt;d&gt; &#39;e&#39; &am <a href='?a=1&b=2&copy=3'>x</a></p>", 0)
    assert got == "# a &amp\n\nb & c <d> 'e' &am [x](?a=1&b=2&copy=3)"


def test_trigrams_travel_as_sums(spark):
    rows = [(1, "the cat sat on the mat and the hat and that is that 😀 " * 9, "en"), (2, "le chat est sur la table et la porte est là, voilà tout " * 9, "fr"), (2, "short", "fr"), (None, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, lang string")
    out = detection.detect(df, "id", "t", detection.fit(df, df.t, df.lang))
    assert sorted(map(str, ((r.id, r.language) for r in out.collect()))) == ["(1, 'en')", "(2, 'fr')", "(2, 'other')", "(None, 'other')"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate [" in line and "_hash#" in line.split("]")[0] and "gram#" in line.split("]")[0]]


@pytest.mark.parametrize("key", ["lifecycle_checks", "lifecycle_cross_checks"])
def test_documents_are_checked_without_joins(spark, sf, key):
    plan = lifecycle.QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_names_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rows = [(f"http://host{i % 7}.example.com/{'é' * (i % 3)}{i}",) for i in range(60)] + [("",), ("a",), ("AB",), ("ab",), ("😀😀",), (None,), ("ab",)]
    names = similarity.distinct_names(spark.createDataFrame(rows, "u string"), "u")
    sets = {n: {f"  {n} "[k : k + 3] for k in range(len(n) + 1)} for n in {u.lower() for (u,) in rows if u is not None}}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.6}
    out = similarity.similar_in_blocks(names, 0.6)
    got = [(r.l, r.r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) > 60
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_in_portions(spark, monkeypatch):
    texts = ["x" * 400_000, None, "y" * 3_000_000, "", "z"] * 3
    batch = pa.record_batch({"id": list(range(15)), "t": texts})
    got = list(corpus._portions(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and len(got) > 3
    assert all(sum(len(t or "") for t in b["t"].to_pylist()[:-1]) <= corpus.PORTION for b in got)
    df = spark.createDataFrame([(1, "# A\nx\n# B\ny"), (2, None), (3, "plain")], "id int, t string")
    assert sorted(tuple(r) for r in corpus.sectioned(df, "id", "t").collect()) == [(1, 0, "A", 1, "x"), (1, 1, "B", 1, "y"), (3, 0, "Document", 1, "plain")]


def _dealt_plan(spark, sf, monkeypatch, key):
    """The plan of a query on 200 parts, which must be dealt 50 to a task, before any text is read."""
    monkeypatch.setattr(tables, "ROWS", 50)
    df = registry.queries()[key](spark, sf)
    assert "RoundRobinPartitioning(4)" in df._jdf.queryExecution().executedPlan().toString()
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wsdl_parts_are_dealt(spark, sf, monkeypatch):
    plan = _dealt_plan(spark, sf, monkeypatch, "wsdl_markdown")
    assert plan.count("<!--.*?-->") == 1  # the text without remarks is formed once


def test_sections_parse_after_dealing(spark, sf, monkeypatch):
    plan = _dealt_plan(spark, sf, monkeypatch, "openapi_sections")
    assert not [line for line in plan.split("\n") if "Filter" in line and "StructField(openapi" in line]


def test_metadata_is_parsed_once(spark, sf, monkeypatch):
    assert _dealt_plan(spark, sf, monkeypatch, "metadata_parse").count("from_json(") < 50


def test_openapi_parts_are_dealt(spark, sf, monkeypatch):
    _dealt_plan(spark, sf, monkeypatch, "openapi_markdown")


def test_apidoc_parts_are_dealt(spark, sf, monkeypatch):
    plan = _dealt_plan(spark, sf, monkeypatch, "apidoc_markdown")
    assert plan.count("from_json(") == 1


def test_proto_parts_are_dealt(spark, sf, monkeypatch):
    _dealt_plan(spark, sf, monkeypatch, "proto_bundle_markdown")


class _State:
    """A key's states and timers, as the processors use them."""

    def __init__(self):
        self.timers, self.held = [], {}
        self.registerTimer = self.timers.append

    def state(self, name, *_):
        held = self.held.setdefault(name, [])
        own = SimpleNamespace(get=lambda: iter(list(held)), appendList=held.extend, appendValue=held.append, exists=lambda: bool(held), clear=held.clear, put=lambda rows: held.__setitem__(slice(None), rows), update=lambda row: held.__setitem__(slice(None), [row]))
        return SimpleNamespace(**own.__dict__ | ({"get": lambda: held[0]} if name in ("alert", "alive") else {}))

    getListState = getValueState = state


def _fired(processor, batches):
    """What one key gives out over batches (rows, watermark in ms), and how many timers each batch of rows set."""
    state, out, counts, seen = _State(), [], [], 0
    processor.init(state)
    for rows, watermark in batches:
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda w=seen: w)
        before = len(state.timers)
        list(processor.handleInputRows((1,), iter([rows]), at))
        counts.append(len(state.timers) - before)
        at, seen = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), watermark
        for t in sorted({t for t in state.timers if t <= watermark}):
            state.timers[:] = [x for x in state.timers if x != t]
            for df in processor.handleExpiredTimer((1,), at, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)):
                out += [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)]
    return out, counts


MINUTE_US = 60_000_000


def test_stale_tasks_set_one_timer_a_batch():
    signs = [i * i * MINUTE_US for i in range(60)]
    frame = lambda rows: pd.DataFrame({"at_us": rows})
    end = 4_000 * 60_000
    out, counts = _fired(state.Staleness(), [(frame(signs[:40]), 1_000 * 60_000), (frame(signs[40:]), end)])
    want, _, _ = state.stale_actions(signs, None, 0, end * 1000, 45 * MINUTE_US, 3)
    assert sorted(r[1:] for r in out) == sorted(want) and counts == [1, 1] and len(out) > 40


def test_waits_set_one_timer_a_batch():
    events = [(i * 7 * MINUTE_US // 3, i, i % 3 != 0) for i in range(200)]
    frame = lambda rows: pd.DataFrame(rows, columns=["at_us", "id", "publish"])
    end = 1_000 * 60_000
    out, counts = _fired(state.Pairing(), [(frame(events[:120]), 150 * 60_000), (frame(events[120:]), end)])
    want = state.pairs_of(events, end * 1000, 60 * MINUTE_US)
    got = [tuple(None if v is None else int(v) for v in r[1:]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert counts == [1, 1] and len(out) > 60


def test_alerts_set_one_timer_a_batch():
    bad = [0, 1, 1, 1, 0, 1, 0, None, 1, 1, None, 1, 0]  # by window of a minute; None: no rows
    rows = [(w * 60_000 + k, b == 1) for w, b in enumerate(bad) if b is not None for k in range(3)]
    frame = lambda rows: pd.DataFrame(rows, columns=["at_ms", "bad"])
    out, counts = _fired(state.AlertState(60_000), [(frame(rows[:14]), 3 * 60_000), (frame(rows[14:]), 20 * 60_000)])
    got = [(r[1] // 60_000, r[2]) for r in out]
    assert got == [(2, "pending"), (3, "firing"), (5, "resolved"), (6, "pending"), (9, "pending"), (10, "firing"), (11, "resolved"), (12, "pending")]
    assert counts == [1, 1]


def test_crawls_are_batches_of_many_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"<p>{i}</p>" if i != 5 else " ") for i in range(40)], "page_id int, html string").repartition(8)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    read, one = [], ingest.ingest_batch
    monkeypatch.setattr(ingest, "ingest_batch", lambda slots, batch, run: read.append(batch.rdd.getNumPartitions()) or one(slots, batch, run))
    monkeypatch.setattr(ingest, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(8))
    got = {r.url: r.version for r in ingest.q_upsert(spark, str(tmp_path)).collect()}
    assert len(read) == 3 and all(n > 1 for n in read)
    assert got["/p/3"] == 2 and got["/p/1"] == 1 and got["/p/27"] == 3 and "/p/5" not in got and got["/new/2"] == 3


def test_postings_are_rows_of_many_documents(spark, tmp_path):
    rows = [(i, "src", f"the license of versions {'version ' * (i % 3)}x{i}") for i in range(100)] + [(500, None, None), (501, "", "  "), (None, "a", "b")]
    path = f"file://{tmp_path}/postings"
    fulltext.build(path, spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1), {"source": "B", "text": "C"})
    held = spark.read.parquet(path)
    license = [r for r in held.where("term = 'license'").collect()]
    assert len(license) == 1 and len(license[0].entries) == 100  # a row for each document and configuration before
    assert sorted(r.configurations for r in held.where("term IN ('versions', 'version')").collect()) == [1, 6, 7]
    got = {r.id: r.covers for r in fulltext.ranked(spark, path, "license versions").collect()}
    assert got == {i: 1 for i in range(100)}
    spots = sorted((r.position, r.weight) for r in fulltext.matches(spark, path, "src version").where("id = 5 AND configuration = 'english'").collect())
    assert spots == [(1, "B"), (5, "C"), (6, "C"), (7, "C")]


def test_vectors_meet_queries_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "PART", 8)
    monkeypatch.setattr(vector_index, "CHUNK", 3)
    v = np.random.default_rng(4).normal(size=(400, 8))
    v[100:180] = v[7]  # copies: ties go to the smaller id
    index = vector_index.build(spark, f"file://{tmp_path}/vectors", spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), lists=8)
    queries = vector_index.usable(spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 400, 7)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    out = index.probe(queries, k=5, exact=True, probes=2)
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query, r["rank"]): (r.id, r.similarity) for r in out.collect()}
    for i in range(0, 400, 7):
        s = np.round(unit @ unit[i], 6)
        want = [j for j in np.lexsort((np.arange(400), -s)).tolist() if j != i][:5]
        assert [got[i, r + 1][0] for r in range(5)] == want
        assert all(abs(got[i, r + 1][1] - s[want[r]]) < 2e-6 for r in range(5))


@pytest.mark.parametrize("key", ["product_debug", "product_debug_full"])
def test_parts_and_lines_meet_in_tasks_of_so_many_rows(spark, sf, monkeypatch, key):
    monkeypatch.setattr(tables, "MEETING", 500)  # of 6,000 lines
    df = registry.queries()[key](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count(", REPARTITION_BY_NUM") == 2 and "Expand" not in plan
    assert df.rdd.getNumPartitions() == 12


def test_rules_are_read_from_one_row_a_document(spark, sf, tmp_path):
    plan = registry.queries()["lifecycle_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1  # six times before
    lines = [(1, 1, 3, 3, 0.0, 0.0, "A"), (1, 2, 3, 5, 0.0, 0.07, "N"), (2, 2, 1, 1, 0.05, 0.0, "A"), (None, 4, 1, 1, 0.0, 0.0, "R"), (4, 4, 1, None, 0.09, 0.07, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, registry.queries()["lifecycle_rules"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(map(tuple, tables.run_sql(spark, str(tmp_path), STATEMENTS["lifecycle_rules"].sql).collect()), key=str)
    assert got == want and len(got) == 10


def test_phases_are_written_before_they_meet(spark):
    phases = spark.createDataFrame([(1, 2, "b", "POST", "/e", "{}", None), (1, 1, "a@e", None, "/@m", None, "n"), (1, 2, "b", "GET", None, None, None), (2, 1, "c", "GET", "/x", "{}", None)], "doc long, step int, action string, method string, endpoint string, body string, notes string")
    settings = spark.createDataFrame([(1, "K", "a@n"), (1, "A", "v"), (3, "K", "v")], "doc long, name string, value string")
    out = lifecycle.skeletons(phases, settings, "doc")
    assert not [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "replace(" in line]
    got = {(r.doc, r.language): r.code for r in out.collect()}
    assert len(got) == 14
    assert got[1, "curl"] == '#!/bin/sh\n\nA="v"\nK="a@n"\n\n# Step 1: a@e\n# n\n\n# Step 2: b\n\n# Step 2: b\ncurl -X POST "/e" -d \'{}\'\n\n'
    assert got[2, "go"] == 'package main\n\n// Step 1: c\ncall(client, "GET", "/x", nil)\n\n'


def test_fused_indexes_make_no_row_for_each_pair(spark, sf):
    plan = registry.queries()["hybrid_index_search"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan


def test_verified_pairs_stay_in_spark(spark, sf, monkeypatch):
    plans = {}
    monkeypatch.setattr(simhash, "saved", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and saved(df, name))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    simhash.resembling_rows(docs)
    assert "array_intersect" in plans["verified"] and "MapInArrow" not in plans["verified"]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "u long, v long")
    sets = spark.createDataFrame([(1, [*range(9)]), (2, [*range(-1, 8)]), (3, [*range(10)]), (4, [*range(2, 12)])], "node long, hashes array<long>")
    assert sorted(map(tuple, simhash._verified(pairs, sets).collect())) == [(1, 2), (1, 3)]  # 8 of 10, 9 of 10; 7 of 12


def test_pipeline_hands_little_to_python_at_once(spark, sf):
    key, most = corpus_pipeline.BATCH
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for own in (None, "1m"):
        session = spark.newSession()
        if own:
            session.conf.set(key, own)
        corpus_pipeline.language_stage(session, docs, sf)
        assert session.conf.get(key) == (own or str(most))
