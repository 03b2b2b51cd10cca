import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators.evaluation import Gates
from tessella.plans import knowledge, settings as st, suite
from tessella.plans.settings import Provider, Settings, load_settings, provider
from tessella.sources import datasets, files
from tessella.sources.snapshots import SnapshotStore
from tessella.streaming.ingest import stream_documents

POLICY = "# 制度\n## 报销\n员工出差后应在 3 天内提交报销材料，包括发票和审批单。逾期会影响审核，请按时提交全部材料并保留付款证明以备查验，谢谢配合。"
OTHER = "# Deploy\nBuild the image, start the service, check the ports and read the health log. Record the release time when the state is confirmed by the person on duty, then write the notes for the next shift and close the ticket in the tracker."


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


@pytest.fixture
def base(spark, tmp_path):
    return knowledge.KnowledgeBase(spark, Settings(store=str(tmp_path / "store")))


def test_add_skip_update_delete(spark, base):
    first = base.sync(docs(spark, a=POLICY, b=OTHER), now=10)
    assert (first.report["added"], first.report["skipped"], first.document_count) == (2, 0, 2)
    again = base.sync(docs(spark, a=POLICY, b=OTHER), now=20)
    assert (again.report["added"], again.report["skipped"], again.report["reembedded_chunks"]) == (0, 2, 0)
    longer = base.sync(docs(spark, a=POLICY + "\n## 新增\n" + OTHER, b=OTHER), now=30)
    assert longer.report["updated"] == 1 and longer.report["reused_chunks"] == 1 and longer.report["reembedded_chunks"] == 1
    rows = {r["doc_id"]: r for r in base.store.manifest().collect()}
    assert (rows["a"]["version"], rows["a"]["updated_at"], rows["b"]["version"], rows["b"]["updated_at"]) == (2, 30, 1, 10)
    gone = base.sync(docs(spark, b=OTHER), now=40)
    assert gone.report["deleted"] == 2 and gone.report["details"] == ["[DEL] a -> removed 2 chunks"] and gone.document_count == 1
    chunks = base.store.read("chunks").collect()
    assert {r["doc_id"] for r in chunks} == {"b"} and all(len(r["vector"]) == 128 for r in chunks)


def test_another_process_sees_the_store(spark, base):
    base.sync(docs(spark, a=POLICY))
    again = knowledge.KnowledgeBase(spark, base.settings)
    assert again.chunk_count() == base.chunk_count() == 1
    assert again.sync(docs(spark, a=POLICY)).report["skipped"] == 1
    base.store.reset()
    assert base.chunk_count() == 0
    with pytest.raises(ValueError):
        base.retrieve(knowledge.one_query(spark, "x"))


def test_broken_pointer_is_an_empty_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.manifest().count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "CURRENT").write_text("nowhere")
    assert store.current() is None


@pytest.mark.parametrize("backend", ["cross_encoder", "colbert", "none"])
def test_ask_and_evaluate(spark, tmp_path, backend):
    kb = knowledge.KnowledgeBase(spark, Settings(store=str(tmp_path / "s"), reranker=backend))
    kb.sync(docs(spark, **{"policy.md": POLICY, "deploy.md": OTHER}))
    queries = spark.createDataFrame([("1", "报销材料几天内提交"), ("2", "check the health log of the service")], "query_id string, query string")
    rows = {r["query_id"]: r for r in kb.ask(queries).collect()}
    assert rows["1"].contexts[0].source == "policy.md" and "3 天" in rows["1"]["answer"]
    assert rows["2"].contexts[0].source == "deploy.md"
    empty = F.array().cast("array<string>")
    labelled = queries.withColumns({"relevant_sources": F.when(F.col("query_id") == "1", F.array(F.lit("policy.md"))).otherwise(empty), "relevant_doc_ids": empty, "relevant_chunk_ids": empty})
    reports = {r["query_id"]: r for r in kb.evaluate(labelled).collect()}
    assert reports["1"]["mrr"] == 1.0 and not reports["2"]["labelled"]
    with pytest.raises(ValueError):
        kb.evaluate(labelled, ks=(0,))


def test_filters_reach_both_channels(spark, base):
    base.sync(docs(spark, a=POLICY, b=OTHER), acl=["hr"])
    q = knowledge.one_query(spark, "报销材料 health log")
    assert {r["source"] for r in base.retrieve(q, {"acl": ["hr"]}).collect()} == {"a", "b"}
    assert base.retrieve(q, {"acl": "public"}).count() == 0
    assert {r["source"] for r in base.retrieve(q, {"source": "b"}).collect()} == {"b"}


def test_parent_child_base(spark, tmp_path):
    kb = knowledge.KnowledgeBase(spark, Settings(store=str(tmp_path / "s"), parent_child=True))
    kb.sync(docs(spark, a=POLICY, b=OTHER))
    rows = kb.ask(knowledge.one_query(spark, "health log service")).collect()[0]
    assert rows["contexts"][0]["chunk_id"] == "b::0" and rows["contexts"][0]["preview"].startswith("[Deploy]")


def test_stream(spark, base, tmp_path):
    source, mark = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    write = lambda name, *rows: (source / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    write("1.json", {"doc_id": "a", "text": POLICY}, {"doc_id": "b", "text": OTHER})
    stream_documents(base, str(source), mark).awaitTermination()
    assert base.store.manifest().count() == 2
    write("2.json", {"doc_id": "a", "deleted": True}, {"doc_id": "c", "text": OTHER + " More."})
    stream_documents(base, str(source), mark).awaitTermination()
    assert {r["doc_id"] for r in base.store.manifest().collect()} == {"b", "c"}
    stream_documents(base, str(source), mark).awaitTermination()
    assert base.store.manifest().count() == 2


WORD = "http://schemas.openxmlformats.org" + "/wordprocessingml/2006/main"


def docx(parts):
    w = f'xmlns:w="{WORD}"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(*parts) if parts else z.writestr("x", f"<a {w}/>")
    return data.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: "<w:p><w:r><w:t>%s</w:t></w:r >" % t + "</w:p>"
    body = p("First") + "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in (("k", "v"), ("x", ""))) + "</w:tbl>" + p("Last")
    xml = f'<w:document xmlns:w="{WORD}" ><w:body >{body}</w:body></w:document>'
    root = tmp_path / "kb"
    for d in ("sub dir", "stores", ".git"):
        (root / d).mkdir(parents=True)
    (root / "a.md").write_text(" # A\ntext \n")
    (root / "sub dir" / "b+c.json").write_bytes(b'{"x": 1}\xff')
    (root / "w.docx").write_bytes(docx(("word/document.xml", xml)))
    (root / "stores" / "no.md").write_text("hidden")
    (root / ".git" / "no.md").write_text("hidden")
    (root / "blank.md").write_text(" \n")
    got = {r["doc_id"]: r["text"] for r in files.read_documents(spark, str(root)).collect()}
    assert got == {"a.md": "# A\ntext", "sub dir/b+c.json": '{"x": 1}', "w.docx": "# w.docx\n\nFirst\n\n| k | v |\n| x |\n\nLast"}
    assert [r["doc_id"] for r in files.read_documents(spark, str(root / "a.md")).collect()] == ["a.md"]
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, str(root / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.md").write_text(" ")
    with pytest.raises(ValueError):
        files.read_documents(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        files.docx_text(docx(None), "bad.docx")
    windows = files.read_char_windows(docs(spark, d="abcdef"), 3, 1).orderBy("chunk").collect()
    assert [(r["chunk_id"], r["content"]) for r in windows] == [("d::w0", "abc"), ("d::w1", "cde"), ("d::w2", "ef")]


def test_ocr_shapes():
    assert files.harvest_ocr([[[[0, 0], ("line one", 0.9)], [[1, 1], ("line two", 0.8)]]]) == ["line one", "line two"]
    assert files.harvest_ocr({"rec_texts": ["a", " ", "b"]}) == ["a", "b"] and files.harvest_ocr([{"res": {"text": "c"}}]) == ["c"] and files.harvest_ocr(None) == []


def test_labelled_queries(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('# note\n\n{"query": " 报销 ", "relevant_sources": ["a.md"]}\n{"query": "x"}\n')
    rows = datasets.read_labelled_queries(spark, str(path)).orderBy("query_id").collect()
    assert [(r["query_id"], r["query"], r["relevant_sources"], r["relevant_chunk_ids"]) for r in rows] == [("3", "报销", ["a.md"], []), ("4", "x", [], [])]
    for text in ("", "# only\n", "{bad", "[1]", '{"query": ""}', '{"query": "x", "relevant_sources": "a"}', '{"query": "x", "relevant_doc_ids": [1]}'):
        path.write_text(text)
        with pytest.raises(ValueError):
            datasets.read_labelled_queries(spark, str(path))


def test_export(spark, base):
    base.sync(docs(spark, a=POLICY))
    rows = datasets.export_chunks(docs(spark, a=POLICY, z="nothing"), base.store.read("chunks")).collect()
    got = {(v := json.loads(r[0]))["doc_id"]: v for r in rows}
    assert got["a"]["chunk_count"] == 1 and got["a"]["raw_length"] == len(POLICY) and got["z"]["chunk_count"] == 0


def test_entry_plans(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "policy.md").write_text(POLICY)
    (tmp_path / "kb" / "deploy.md").write_text(OTHER)
    s = Settings(store=str(tmp_path / "s"))
    out = knowledge.run_all(spark, str(tmp_path / "kb"), "报销 提交 材料", s, labels={"relevant_sources": ["policy.md"]})
    assert out["index"].report["added"] == 2 and [c["source"] for c in out["query"]["contexts"]][0] == "policy.md" and out["evaluation"]["summary"]["average_mrr"] == 1.0
    for bad in ({"query": "a", "dataset": "b"}, {}):
        with pytest.raises(ValueError):
            knowledge.run_evaluation(spark, s, **bad)
    with pytest.raises(ValueError):
        knowledge.run_query(spark, " ", s)


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nexport TESSELLA_TOP_K=7\nTESSELLA_RERANKER='colbert'\nTESSELLA_CANDIDATES=many\n")
    got = load_settings((str(env), str(tmp_path / "none")), {"TESSELLA_TOP_K": "9", "TESSELLA_PARENT_CHILD": "yes"})
    assert (got.top_k, got.reranker, got.candidates, got.parent_child) == (9, "colbert", 100, True)
    assert got.checked().reranker == "late"
    for bad in (Settings(reranker="x"), Settings(provider="x"), Settings(top_k=0)):
        with pytest.raises(ValueError):
            bad.checked()


def test_providers():
    f = lambda c, n: c
    st.register_provider(" Mine ", Provider(f, None))
    try:
        assert "mine" in st.list_providers() and provider("MINE").require_embed() is f
        with pytest.raises(ValueError):
            st.register_provider("mine", Provider())
        st.register_provider("mine", Provider(f, f), overwrite=True)
        mixed = provider({"embed": "mine", "answer": "mock"})
        assert mixed.embed is f and mixed.answer is provider("mock").answer
        assert provider({"name": "mock", "embed": f}).embed is f
        for bad, error in (({"embed": 3}, TypeError), ({"x": 1}, ValueError), (3, TypeError), ("none", ValueError)):
            with pytest.raises(error):
                provider(bad)
        with pytest.raises(TypeError):
            st.register_provider("n", "not a provider")
        with pytest.raises(RuntimeError):
            Provider().require_answer()
    finally:
        st.unregister_provider("mine")


def case(i, docs, query, relevant, expected, forbidden=(), category="facts", **more):
    return {"case_id": f"case-{i}", "category": category, "documents": [{"source": s, "content": c} for s, c in docs], "query": query, "relevant_sources": relevant, "expected_answer_terms": expected, "forbidden_answer_terms": list(forbidden), **more}


PAD = " 其他说明文字用于补足长度，避免片段过短而被丢弃，这里没有任何与问题有关的信息，请忽略这些补充内容并继续阅读下文。"
CASES = [
    case(1, [("expense.md", "# 报销\n员工应在 3 天内提交发票和审批单。" + PAD), ("deploy.md", "# 部署\n先构建镜像，再启动服务并检查端口。" + PAD)], "报销几天内提交，需要什么材料", ["expense.md"], ["3 天", "发票"], ["7 天"]),
    case(2, [("a.md", "# Memory\nThe memory module keeps ten messages and drops the oldest one first when a new message arrives in a long conversation, so that prompts stay short and the model sees recent turns only." ), ("b.md", "# Network\nThe network module opens sockets, retries failed calls three times with growing pauses, and closes idle connections after a minute so that ports are never used up by clients.")], "how many messages does memory keep", ["a.md"], ["ten messages"], ["sockets"], category="english"),
    case(3, [("old.md", "# 旧版\n退款期限为 30 天，本页已经过时。" + PAD), ("refund.md", "# 退款政策\n退款期限为 7 天，自签收日起计算，退款须附订单号。" + PAD)], "退款政策 期限 签收 订单号", ["refund.md"], ["7 天"], ["30 天"], category="versions"),
]


def test_suite(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("# cases\n" + "\n".join(json.dumps(c, ensure_ascii=False) for c in CASES))
    report = suite.run_suite(spark, str(path), Gates(max_p95_case_latency_ms=1e9))
    assert report["ok"] and report["metrics"]["hit_rate_at_1"] == 1.0, report["results"]
    assert report["coverage"] == {"english": 1, "facts": 1, "versions": 1}
    strict = suite.run_suite(spark, str(path), Gates(max_p95_case_latency_ms=0.0))
    assert strict["failed_gates"] == ["max_p95_case_latency_ms"] and strict["dataset_sha256"] == report["dataset_sha256"]


def test_case_rules(spark, tmp_path):
    good = CASES[0]
    d = good["documents"]
    bad = [
        {**good, "case_id": "Not A Slug"}, {**good, "query": " "}, {**good, "documents": []}, {**good, "relevant_sources": ["nope.md"]}, {**good, "top_k": 0}, {**good, "expected_answer_terms": []},
        {**good, "forbidden_answer_terms": ["发票"]}, {**good, "expected_answer_terms": ["a", "a"]}, {**good, "documents": [d[0], d[0]]}, {**good, "documents": [{"source": "../x.md", "content": "c"}, d[0]]},
    ]
    path = tmp_path / "c.jsonl"
    for c in bad:
        path.write_text(json.dumps(c, ensure_ascii=False))
        with pytest.raises(ValueError):
            datasets.read_cases(spark, str(path))
    for text in (json.dumps(good) + "\n" + json.dumps(good), "", "{x"):
        path.write_text(text)
        with pytest.raises(ValueError):
            datasets.read_cases(spark, str(path))
