"""Top-k search, chat formatting and the pipeline."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from chronoloom.llm import langid, toolcalls, topk

from .conftest import SF, odd_rows

REPO = Path(__file__).resolve().parents[2]


def direct_top(vectors, queries, k):
    """(query, rank, vec_id, score) by sorting everything; vectors is a list of (id, components)."""
    width = max(len(v) for _, v in vectors)
    pad = lambda v: [*v, *[0] * (width - len(v))]
    out = []
    for q, qv in queries:
        scored = sorted(((-sum(a * b for a, b in zip(pad(qv), pad(v), strict=True)), i) for i, v in vectors if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("low,high", [(-30, 30), (0, 3), (-2 ** 29, 2 ** 29), (-2 ** 20, 2 ** 20)])
def test_top_k_equals_sorting_all(spark, monkeypatch, low, high):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "GROUP_ROWS", 20)
    rng = np.random.default_rng(abs(low) % 97)
    vectors = [(int(i), [int(x) for x in rng.integers(low, high + 1, 6)]) for i in range(-20, 230)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(40)] + [(2000, [1, 2]), (2001, [])]
    docs = spark.createDataFrame(vectors + vectors[:7], "vec_id long, v array<long>").repartition(3)
    queries = [v for v in vectors if v[0] % 20 == 0]
    got = topk.top_k(docs.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), docs, 7)
    assert sorted(tuple(r) for r in got.collect()) == direct_top(vectors, queries, 7)


def test_top_k_prunes_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    ids = np.arange(2048)
    vectors = np.repeat(rng.integers(-50, 50, (8, 16)), 256, axis=0) + rng.integers(-2, 3, (2048, 16))
    blocks, seen = topk.Blocks(ids, vectors), []
    score = topk.Blocks._score
    monkeypatch.setattr(topk.Blocks, "_score", lambda self, rows, *a: (seen.append(len(rows)), score(self, rows, *a))[1])
    row, found, scores = blocks.search(np.array([-1, -2]), vectors[[3, 700]], 5)
    assert sum(seen) < 2 * 8
    for k, q in enumerate(vectors[[3, 700]]):
        best = sorted(zip(-(vectors @ q), ids, strict=True))[:5]
        assert [(-s, i) for s, i in best] == sorted(zip(scores[row == k], found[row == k], strict=True), key=lambda x: (-x[0], x[1]))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.5, -0.01]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (None, [9.0, 9.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = df.where(topk.usable("embedding")).select("vec_id", topk.scaled("embedding").alias("v"))
    assert {r["vec_id"]: list(r["v"]) for r in kept.collect()} == {0: [32, -1], 5: [64, 64], None: [576, 576], 6: [-64, 0]}
    got = topk.top_k(kept.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), kept)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 5, 1984), (0, 2, 6, -2048)]
    assert topk.top_k(kept.limit(0).withColumnRenamed("vec_id", "query_id"), kept).collect() == []
    assert topk.top_k(kept.withColumnRenamed("vec_id", "query_id"), kept.limit(0)).collect() == []


SCHEMAS = {
    "add": {"a": toolcalls.Field("integer", least=0, most=9), "b": toolcalls.Field("number", required=False)},
    "say": {"text": toolcalls.Field("string", least=1, most=5), "loud": toolcalls.Field("boolean", required=False),
            "to": toolcalls.Field("array", required=False), "how": toolcalls.Field("object", required=False)},
}


def errors_of(spark, name, arguments):
    df = spark.createDataFrame([(name, arguments)], "n string, a string")
    return list(df.select(toolcalls.argument_errors(df["n"], df["a"], SCHEMAS)).first()[0])


@pytest.mark.parametrize("name,arguments,want", [
    ("add", '{"a": 3, "b": 1.5}', []), ("add", '{"a": 3, "b": 2}', []), ("add", '{"b": 2}', ["a:missing"]),
    ("add", '{"a": "3"}', ["a:type"]), ("add", '{"a": 10}', ["a:range"]), ("add", '{"a": -1, "c": 1, "d": null}', ["a:range", "c:unknown", "d:unknown"]),
    ("add", '{"a": 1.5}', ["a:type"]), ("add", '{"a": null}', ["a:type"]), ("add", '{"a": 1, "b": true}', ["b:type"]),
    ("say", '{"text": "hi", "loud": true, "to": [1], "how": {"x": 1}}', []), ("say", '{"text": ""}', ["text:range"]),
    ("say", '{"text": "longer"}', ["text:range"]), ("say", '{"text": "hi", "loud": 1, "to": {}, "how": []}', ["how:type", "loud:type", "to:type"]),
    ("sing", "{}", ["unknown name"]), (None, "{}", ["unknown name"]), ("add", "[1]", ["not an object"]), ("add", "{", ["not an object"]),
    ("add", None, ["not an object"]), ("add", '{"a": 1, "a": 2}', ["not an object"]),
])
def test_arguments_against_schemas(spark, name, arguments, want):
    assert errors_of(spark, name, arguments) == want


def test_calls_are_linked_ordered_and_written(spark):
    calls = [
        (1, "root", None, "add", '{"b": 1, "a": 2}'), (1, "next", "root", "say", '{"text":"é\\"\\n"}'), (1, "lost", "nowhere", "add", '{"a":1}'),
        (1, "x", "y", "add", '{"a":1}'), (1, "y", "x", "add", '{"a":1}'), (1, "after-circle", "x", "add", '{"a":1}'),
        (1, "root", None, "add", '{"b": 1, "a": 2}'), (None, "root", None, "sing", "{"), (2, "root", None, None, None), (1, None, None, "add", "{}"),
    ]
    results = [(1, "root", "3"), (1, "root", "2"), (1, "stray", "?"), (None, "root", None), (2, None, "z")]
    out = toolcalls.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, name string, arguments string"),
                               spark.createDataFrame(results, "conv_id long, call_id string, content string"), SCHEMAS)
    rows = out.collect()
    other = [r for r in rows if r["depth"] is None and "repeated id" in r["errors"]]
    got = {(r["conv_id"], r["call_id"]): r for r in rows if r not in other}
    assert len(got) == len(rows) - 1 == 9
    assert [(r["conv_id"], r["call_id"], json.loads(r["message"])["result"]) for r in other] == [(1, "root", "3")]
    root = got[1, "root"]
    assert (root["depth"], root["copies"], root["n_results"], list(root["errors"])) == (0, 2, 2, ["repeated id"])
    assert root["message"] == '{"arguments":{"a":2,"b":1},"id":"root","name":"add","parent":null,"result":"2"}'
    assert got[1, "next"]["depth"] == 1 and list(got[1, "next"]["errors"]) == ["no result"]
    assert json.loads(got[1, "next"]["message"])["arguments"] == {"text": 'é"\n'}
    assert (got[1, "lost"]["depth"], list(got[1, "lost"]["errors"])) == (0, ["no parent", "no result"])
    for name in ("x", "y", "after-circle"):
        assert got[1, name]["depth"] is None and "circle" in got[1, name]["errors"]
    assert list(got[1, "stray"]["errors"]) == ["no call"] and got[1, "stray"]["name"] is None
    assert got[None, "root"]["n_results"] == 1 and json.loads(got[None, "root"]["message"]) == {
        "arguments": "{", "id": "root", "name": "sing", "parent": None, "result": None}
    assert list(got[2, "root"]["errors"]) == ["unknown name", "no result"]


def test_no_call_and_no_result_is_lost(spark):
    """Different calls and results of one identifier all come out, equal ones once; missing parts are compared as well."""
    calls = [(1, "c0", None, "add", '{"a":1}'), (1, "c0", None, "add", '{"a":2}'), (1, "c0", "c0", None, None), (1, "c0", None, "add", '{"a":2}'),
             (None, "c0", None, "add", '{"a":3}'), (None, "c0", None, "add", "{oops")]
    results = [(1, "c0", "r1"), (1, "c0", "r2"), (1, "c0", "r2"), (1, "c0", None), (2, "s", "x"), (2, "s", "y")]
    out = toolcalls.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, name string, arguments string"),
                               spark.createDataFrame(results, "conv_id long, call_id string, content string"), SCHEMAS).collect()
    written = [(r["conv_id"], json.loads(r["message"])) for r in out]
    assert sorted(str((c, m["parent"], m["name"], m["arguments"])) for c, m in written if m["name"] or m["parent"]) == sorted(map(str, [
        (1, None, "add", {"a": 1}), (1, None, "add", {"a": 2}), (1, "c0", None, None), (None, None, "add", {"a": 3}), (None, None, "add", "{oops")]))
    assert sorted((c, m["result"]) for c, m in written if m["result"]) == [(1, "r1"), (1, "r2"), (2, "x"), (2, "y")]
    assert all("repeated id" in r["errors"] for r in out)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, real = [], toolcalls.checkpointed
    monkeypatch.setattr(toolcalls, "checkpointed", lambda df: (rounds.append(1), real(df))[1])
    calls = spark.createDataFrame([(7, str(i), str(i - 1) if i else None) for i in range(300)], "conv_id long, call_id string, parent_id string")
    got = {r["call_id"]: r["depth"] for r in toolcalls.call_depths(calls).collect()}
    assert got == {str(i): i for i in range(300)} and len(rounds) <= 11


def test_no_calls(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    assert toolcalls.link_calls(calls, results, SCHEMAS).collect() == []
    messages = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, None, "user", "x"), (2, 5, None, "y")],
                                     "conv_id long, turn long, role string, text string")
    got = {r["call_id"]: r for r in toolcalls.link_calls(*toolcalls.conversation_calls(messages), toolcalls.TURNS).collect()}
    assert sorted(got) == ["0", "1"]
    assert got["1"]["depth"] == 1 and list(got["1"]["errors"]) == ["prompt:missing"]


def test_chat_formatting_stays_in_the_jvm(spark):
    messages = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = toolcalls.link_calls(*toolcalls.conversation_calls(messages), toolcalls.TURNS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_each_stage_does_what_its_operator_says(spark, documents, tmp_path):
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    columns, texts = docs.columns, {d["doc_id"]: d["text"] for d in documents}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(spark, stage(spark, docs, SF), tmp_path / str(k))
        after.append({r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == columns
    language, lined, single, clean, packed = after

    predicted = {r["doc_id"]: r for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(language) == {i for i, r in predicted.items() if r["lang_pred"] != "und" and r["score"] >= 0.3}
    assert all(language[i]["text"] == texts[i] for i in language)

    from .test_dedup import direct_groups, direct_lines
    want = {i: t for i, t, _, _ in direct_lines([(i, r["text"], r["source"]) for i, r in language.items()])}
    assert {i: r["text"] for i, r in lined.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined.values())

    assert set(single) == {i for i, _, c in direct_groups([(i, r["text"]) for i, r in lined.items()]) if i == c}

    from .test_text import check_packing, direct_contamination
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, _, n, _ in direct_contamination([(i, r["text"]) for i, r in single.items()], items) if not n}
    used, total = check_packing(packed, [(i, r["text"]) for i, r in clean.items()], 2048)
    assert used <= -(-total // 2048) + 1

    run = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_rows(odd, none, spark):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, none, SF).collect() == [], name
    assert corpus_pipeline.STAGES[4][1](spark, none, SF).collect() == []
    kept = {name: {r["doc_id"] for r in stage(spark, odd, SF).collect()} for name, stage in corpus_pipeline.STAGES[1:4]}
    everything = {r[0] for r in odd_rows()}
    assert kept["line_dedup"] == everything
    assert kept["simhash_near_dedup"] < everything and kept["benchmark_decontamination"] == everything



def test_the_rest_works_without_this_package(tmp_path):
    """A copy of the repository without the package and the pipeline still imports and registers its other queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
    (copy / "corpus_pipeline.py").write_text("import missing_module\n")
    assert subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=copy, capture_output=True,
                          env=os.environ | {"PYTHONPATH": str(copy)}).returncode
