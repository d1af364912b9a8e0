"""Core operators on hand-made rows whose results follow from the rules, for what the tables never trigger."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from scriptorium.errors import DocumentLoadError, EngineError, GenerationError, RetrievalError, VectorStoreError
from scriptorium.functions import text as T
from scriptorium.functions import vector as V
from scriptorium.functions.exact import exact_mean
from scriptorium.functions.splitter import fixed_split, split_text
from scriptorium.operators import answering as A
from scriptorium.operators import chunking as C
from scriptorium.operators import evaluation as E
from scriptorium.operators import graph as G
from scriptorium.operators import vectors as X
from scriptorium.operators.conversation import Conversation, Passage
from scriptorium.operators.index import Index
from scriptorium.sources import files

CLEAN_IN = "Intro\n\nﬁrst line here  \n-----\n\n\n\nSecond\tpart\x00  item\n12\n\nTail"
CLEAN_OUT = "Intro\n\nfirst line here\n\nSecond\tpart • item\n12\n\nTail"


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    got = column(spark, [CLEAN_IN, "a\n \n \n \nb", None, "", "==\n===\nx\r\ny\x0bz"], T.clean_text)
    assert got == [CLEAN_OUT, "a\n\n\n\nb", None, "", "==\n\nx\ny\nz"]


def test_sentences(spark):
    assert column(spark, ["Short. This one is kept! Is e.g. this split?  Tail without stop"], T.sentences) == [["This one is kept!", "this split?", "Tail without stop"]]


def test_small_text_functions(spark):
    assert column(spark, ["x" * 300, "x" * 301], T.truncated) == ["x" * 300, "x" * 300 + "..."]
    assert column(spark, ["  ab ", " abc\n", "y" * 90, None], T.selection_preview) == [None, "abc", "y" * 80 + "...", None]
    assert column(spark, [0.0, 0.5, 1.0], T.score_bar, "double") == ["-" * 30, "#" * 15 + "-" * 15, "#" * 30]
    raw = bytes(range(256)) * 3
    assert column(spark, [raw], T.base64_text, "binary") == [base64.b64encode(raw).decode()]


def test_chunk_ids(spark):
    rows = spark.createDataFrame([("GDPR_EN.pdf", "1", 0, "Ärger"), ("shot.png", "image", 3, "abc"), (None, "1", 0, "x")], "s string, p string, i int, t string")
    assert [r[0] for r in rows.select(T.chunk_id(F.col("s"), F.col("p"), F.col("i"), F.col("t"))).collect()] == ["b2d4b7f29cb4b924f9153a22f5f3026e", "9edce693ade540feba527c4acdf57422", None]


def test_headings_and_sections(spark):
    pages = spark.createDataFrame([("s", "1", CLEAN_OUT)], "source string, page string, text string")
    assert [(r.offset, r.heading) for r in C.headings(pages).orderBy("offset").collect()] == [(0, "Intro"), (7, "first line here")]
    marks = spark.createDataFrame([("s", "1", 10, "B"), ("s", "1", 0, "A"), ("s", "2", 5, "C")], "source string, page string, offset int, heading string")
    asks = spark.createDataFrame([("s", "1", k, 1, "t", c) for k, c in enumerate((0, 9, 10, 99))] + [("s", "2", 0, 1, "t", 4), ("s", "3", 0, 1, "t", 4)], "source string, page string, chunk_index int, total_chunks int, text string, cursor int")
    got = C.nearest_section(asks, marks).orderBy("page", "cursor").collect()
    assert [r.section for r in got] == ["A", "A", "B", "B", "Unknown", "Unknown"]


def test_process_pages_keeps_numbers_of_dropped_chunks(spark):
    pages = spark.createDataFrame([("f.pdf", "1", "|".join(["x" * 60, "y" * 20, "z" * 70]))], "source string, page string, raw_text string")
    got = C.process_pages(pages, lambda t: F.split(t, r"\|")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.section, r.doc_type) for r in got] == [(0, 3, "Unknown", "pdf"), (2, 3, "Unknown", "pdf")]
    assert [r.cursor for r in C.numbered_chunks(pages.withColumnRenamed("raw_text", "text"), lambda t: F.split(t, r"\|")).orderBy("chunk_index").collect()] == [0, 60, 80]


def plain_split(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """The described rules, literally: pieces in lists, one after the other."""
    while len(separators) > 1 and separators[0] not in text:
        separators = separators[1:]
    first, later = separators[0], separators[1:]
    if first:
        parts = text.split(first)
        pieces = [parts[0]] + [first + p for p in parts[1:]]
    else:
        pieces = list(text)
    out, buffer = [], []

    def flush():
        current = []
        for piece in buffer:
            if sum(map(len, current)) + len(piece) > size:
                out.append("".join(current).strip())
                while current and (sum(map(len, current)) > overlap or sum(map(len, current)) + len(piece) > size):
                    current.pop(0)
            current.append(piece)
        out.append("".join(current).strip())
        buffer.clear()

    for piece in pieces:
        if piece == "":
            continue
        if len(piece) < size:
            buffer.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, size, overlap, later) if later else [piece])
    flush()
    return [c for c in out if c]


def test_splitter():
    assert split_text("abc", 10, 2) == ["abc"]
    assert split_text("", 10, 2) == []
    assert split_text(" \n\n ", 10, 2) == []
    assert split_text("aa\n\nbb\n\ncc", 6, 0) == ["aa\n\nbb", "cc"]
    assert split_text("one two three four", 9, 4) == ["one two", "three", "four"]
    assert split_text("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    assert split_text("ab cd\n\ne f g h i j", 6, 2) == ["ab cd", "e f g", "g h i", "i j"]
    text = "Lorem ipsum dolor. Sit amet,\nconsectetur\n\nadipiscing elit é ü. " * 20
    for size, overlap in ((2, 1), (20, 5), (50, 10), (50, 0), (200, 50), (200, 199)):
        assert split_text(text, size, overlap) == plain_split(text, size, overlap)


def test_splitter_agrees_with_the_plain_one_on_all_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["".join(t.split()) for t in texts[:20]]  # nothing to cut at
    for t in texts:
        assert split_text(t or "") == plain_split(t or "", 500, 100)
        assert split_text((t or "")[:3000], 60, 25) == plain_split((t or "")[:3000], 60, 25)


def test_default_pages(spark):
    """The default path of a page: cleaned, split by the recursive splitter, short chunks left out, sections by place."""
    body = "Some words of a sentence that goes on. " * 30
    pages = spark.createDataFrame([("f.pdf", "1", f"TITLE\x00\n\n{body}\n-----\n\n\n\nNEXT\n\n{body}tiny")], "source string, page string, raw_text string")
    cleaned = pages.select(T.clean_text(F.col("raw_text"))).first()[0]
    want = [(i, c) for i, c in enumerate(plain_split(cleaned, 500, 100)) if len(c) >= 50]
    got = C.process_pages(pages).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.text) for r in got] == want
    assert got[0].section == "TITLE" and got[-1].section == "NEXT" and {r.total_chunks for r in got} == {len(plain_split(cleaned, 500, 100))}


def test_splitter_overlap_is_whole_pieces():
    words = [f"w{i:02d}" for i in range(12)]
    chunks = split_text(" ".join(words), 20, 8)
    assert chunks[0] == "w00 w01 w02 w03 w04"
    assert chunks[1].split()[0] == "w03" and chunks[1].split()[1] == "w04"


def test_fixed_split(spark):
    assert column(spark, ["a" * 500, "b" * 501, "", "c" * 900], lambda t: F.transform(fixed_split(t), F.length)) == [[500], [500, 101], [0], [500, 500]]


def test_physical_pages_keep_gaps(spark):
    df = spark.createDataFrame([("f", ["one", " \n ", "three"])], "source string, pages array<string>")
    assert [(r.page, r.page_num) for r in C.physical_pages(df).collect()] == [("1", 1), ("3", 3)]


def test_confidence_after_rounding(spark):
    got = column(spark, [0.7499, 0.74996, 0.75, 0.5, 0.49994], lambda x: V.confidence(V.score(x)), "double")
    assert got == ["Medium", "High", "High", "Medium", "Low"]


def test_cosine_of_nothing_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def collection(spark):
    sources = "a b b a c a d".split()
    rows = [(f"c{i}", s, [1.0, 0.1 * i]) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "chunk_id string, source string, embedding array<double>")


def test_selection_search_and_fallback(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "z")], "query_id int, embedding array<double>, wanted string")
    got = X.selection_search(collection(spark), asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "c0"), (1, "c3"), (2, "c0"), (2, "c1")]
    wide = X.selection_search(collection(spark), asked.where("query_id = 1"), 3, prefilter=True).orderBy("rank").collect()
    assert [r.chunk_id for r in wide] == ["c0", "c3", "c5"]


def test_search_paths_agree(spark, monkeypatch):
    asked = spark.createDataFrame([(i, [1.0, 0.05 * i]) for i in range(6)] + [(9, [0.0, 0.0])], "query_id int, embedding array<double>")
    by_matrix = sorted(map(tuple, X.search(collection(spark), asked, 3).select("query_id", "rank", "chunk_id", "score").collect()))
    monkeypatch.setattr(X, "MATRIX_QUERIES", 2)
    assert sorted(map(tuple, X.search(collection(spark), asked, 3).select("query_id", "rank", "chunk_id", "score").collect())) == by_matrix
    assert X.search(collection(spark).limit(0), asked, 3).count() == 0


def test_search_paths_agree_on_null_and_uneven_vectors(spark, monkeypatch):
    rows = [("n", None), ("h", [1.0, None]), ("l", [1.0, 0.0, 0.0]), ("s", [1.0]), ("b", [-1.0, 0.0]), ("c", [-1.0, 1.0]), (None, [1.0, 0.0])]
    stored = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0, 0.0]), (4, [None, 1.0])], "query_id int, embedding array<double>")
    want = [(1, 1, "c", -0.7071), (1, 2, "b", -1.0), (3, 1, "l", 0.7071)]
    for most in (X.MATRIX_QUERIES, 1):
        monkeypatch.setattr(X, "MATRIX_QUERIES", most)
        assert sorted(map(tuple, X.search(stored, asked, 3).select("query_id", "rank", "chunk_id", "score").collect())) == want


def test_upsert_is_idempotent_and_leaves_stale_rows(spark):
    old = spark.createDataFrame([("1", "f", "x"), ("2", "f", "y")], "chunk_id string, source string, text string")
    new = spark.createDataFrame([("2", "f", "z"), ("3", "f", "w")], "chunk_id string, source string, text string")
    once = X.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("1", "f", "x"), ("2", "f", "z"), ("3", "f", "w")]
    assert sorted(map(tuple, X.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(r.chunk_id for r in X.replace_source(old, new).collect()) == ["2", "3"]


def test_histogram_closes_its_last_bin(spark):
    hits = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "score double")
    assert [(r.bin, r.n) for r in X.score_histogram(hits, 2).orderBy("bin").collect()] == [(0, 1), (1, 2)]
    same = spark.createDataFrame([(0.5,), (0.5,)], "score double")
    assert [(r.bin, r.n) for r in X.score_histogram(same).collect()] == [(0, 2)]


def test_names(spark):
    assert column(spark, ["the  Volkswagen\nGroup", "THE VOLKSWAGEN GROUP", "The", "Theory X"], G.normalise) == ["Volkswagen Group", "VOLKSWAGEN GROUP", "", "Theory X"]
    assert column(spark, ["VW_Annual_Report_2023.PDF", "a.pdf.txt"], G.document_node) == ["VW Annual Report 2023", "a.pdf.txt"]


def test_rejections_in_order(spark):
    df = spark.createDataFrame([("", "B"), ("A", "a"), ("A-", "a-"), ("A-", "B"), ("A", "B")], "a string, b string")
    assert [r[0] for r in df.select(G.reject_reason(F.col("a"), F.col("b"))).collect()] == ["garbage", "self_loop", "self_loop", "garbage", None]


def small_graph(spark):
    pairs = ["DA", "DB", "AB", "AB", "BC", "BA", "CE"]
    return spark.createDataFrame([(p[0], p[1], "r", "s", str(i), f"text {i}", i) for i, p in enumerate(pairs)], "src string, dst string, relation string, source string, page string, chunk_text string, seq bigint")


@pytest.mark.parametrize(("start", "want"), [("D", ["D A", "D B", "D A B", "D A B", "D B C", "D B A"]), ("A", ["A B", "A B", "A B C", "A B A"]), ("E", [])])
def test_traverse(spark, start, want):
    starts = spark.createDataFrame([(1, start, 1)], "query_id int, node string, start_rank int")
    got = G.traverse(small_graph(spark), starts, 2).orderBy("level", "order_key").collect()
    assert [" ".join(r.path) for r in got] == want


def test_graph_retrieve_stops_at_n(spark):
    starts = spark.createDataFrame([(1, "D", 1), (1, "A", 2)], "query_id int, node string, start_rank int")
    got = G.graph_retrieve(small_graph(spark), starts, 2, 3).orderBy("rank").collect()
    assert [r.chunk_text for r in got] == ["text 0", "text 1", "text 2"]


def test_node_index_keeps_the_last_spelling(spark):
    rows = spark.createDataFrame([("Ab", "x", 1), ("AB", "y", 2), ("Ab", "z", 3)], "src string, dst string, seq bigint")
    assert {r.node_key: r.node for r in G.node_index(rows).collect()}["ab"] == "AB"


def test_routes(spark):
    asked = ["Please give an OVERVIEW and compare", "canvas", "tvs", "find all x", "hello"]
    assert column(spark, asked, A.route) == ["summarizer", "retriever", "comparator", "extractor", "retriever"]


def test_enrichment(spark):
    log = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "h1"), ("assistant", "a1"), ("user", "h2"), ("assistant", "a2")])], "conv_id int, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "and then?"), (2, "and then?")], "conv_id int, question string")
    assert {r.conv_id: r.enriched for r in A.enriched(asked, log).collect()} == {1: "h1 h2 and then?", 2: "and then?"}
    long = spark.createDataFrame([(1, "one two three four five six")], "conv_id int, question string")
    assert [r.enriched for r in A.enriched(long, log).collect()] == ["one two three four five six"]


def hits(spark):
    rows = [(1, k + 1, f"c{k}", "A sentence that is long enough. Another one follows here.", d, p, "S", 0.9 - 0.1 * k, "High" if k < 2 else "Medium", "pdf") for k, (d, p) in enumerate([("d1", "1"), ("d2", "3"), ("d1", "1"), ("d1", "2")])]
    return spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, text string, source string, page string, section string, score double, confidence string, doc_type string")


def test_sources_and_prompts(spark):
    got = A.sources(hits(spark)).orderBy("position").collect()
    assert [(r.document, r.page, round(r.score, 1)) for r in got] == [("d1", "1", 0.9), ("d2", "3", 0.8), ("d1", "2", 0.6)]
    context = A.contexts(hits(spark).where("rank = 1")).first().context
    assert context == "DOCUMENT CONTEXT:\n\n[1] Source: d1 | Page: 1 | Section: S | Confidence: High\nA sentence that is long enough. Another one follows here.\n"
    df = spark.createDataFrame([("q", None, "H"), ("q", "C", None)], "q string, c string, h string")
    assert [r[0] for r in df.select(A.user_message(F.col("q"), F.col("c"), F.col("h"))).collect()] == [f"H\n\n{A.NO_CONTEXT}\n\nUSER QUESTION: q", "C\n\nUSER QUESTION: q"]
    asked = spark.createDataFrame([(1, "give a summary"), (2, "nothing")], "query_id int, question string")
    rows = {r.query_id: r for r in A.answered(asked, hits(spark)).collect()}
    assert (rows[1].tool_used, rows[1].status, rows[1].confidence, rows[1].n_sources) == ("summarizer", "ok", "High", 3)
    assert (rows[2].answer, rows[2].status, rows[2].confidence, rows[2].n_sources) == (A.NO_CONTEXT, "no_context", "Low", 0)


def test_evaluation_modes(spark):
    per = spark.createDataFrame([(1, 1.0, 1.0, 0.5, 1.0), (2, None, None, None, None)], "qa_id int, answer_relevancy double, faithfulness double, context_precision double, context_recall double")
    one = E.report(per).first()
    assert (one.faithfulness, one.context_precision, one.num_evaluated) == (1.0, 0.5, 1)
    asked = spark.createDataFrame([(1, "t", "vector"), (2, "t", "vector")], "qa_id int, question_type string, method string")
    two = E.comparison(asked, per.withColumn("method", F.lit("vector"))).first()
    assert (two.faithfulness, two.context_precision, two.zero_result_rate, two.num_questions) == (0.5, 0.25, 0.5, 2)
    with pytest.raises(RetrievalError):
        E.retrieved_by("magic", per, per)


def test_index_end_to_end(spark, tmp_path):
    long = "Volkswagen Group met Porsche Holding in Berlin today for a long talk about cars and more. "
    (tmp_path / "a.PDF").write_text("HEADING\n\n" + long * 3 + "\f \n\f" + long * 2)
    (tmp_path / "b.pdf").write_text(long * 9)
    (tmp_path / "i.png").write_bytes(b"x" * 20)
    index = Index(spark, f"file://{tmp_path}/store", ocr=lambda data, media: F.concat(F.lit("text seen in the picture, of type "), media, F.lit(" and of some length, "), F.length(data).cast("string")))
    assert sorted(index.ingest_documents([str(tmp_path / "a.PDF"), str(tmp_path / "b.pdf")])) == [("a.PDF", 2, "success"), ("b.pdf", 2, "success")]
    before = index.edges().count()
    index.ingest_documents(str(tmp_path / "b.pdf"))
    assert index.count() == 4 and index.edges().count() > before
    assert {(r.source, r.page, r.section) for r in index.chunks().collect()} >= {("a.PDF", "1", "HEADING"), ("a.PDF", "3", "Unknown")}
    assert index.ingest_images(str(tmp_path / "i.png")) == [("i.png", 1, "success")]
    assert index.list_documents() == ["a.PDF", "b.pdf", "i.png"]
    assert index.delete_document("b.pdf") == 2 and index.delete_document("b.pdf") == 0
    assert index.stats().first().total_chunks == 3
    assert index.ingest_documents(str(tmp_path / "x.txt"))[0][2].startswith("error")
    assert index.vectors().where("size(embedding) = 384").count() == 3
    (tmp_path / "a.PDF").write_text(long)
    index.ingest_documents([str(tmp_path / "a.PDF")])
    assert index.count() == 4  # the new chunk, and two of the file as it was
    index.add(C.process_pages(files.document_pages(spark, str(tmp_path / "a.PDF"))), replace=True)
    assert index.count() == 2
    index.delete_document("a.PDF", cascade=True)
    assert index.edges().where("source = 'a.PDF'").count() == 0 and index.list_documents() == ["i.png"]
    assert index.chunk_table.compact(index.version, f"file://{tmp_path}/small").newest().count() == 1


def test_index_reopens_without_loss(spark, tmp_path):
    long = "Volkswagen Group met Porsche Holding in Berlin today for a long talk about cars and more. "
    (tmp_path / "a.pdf").write_text(long * 9)
    (tmp_path / "b.pdf").write_text(long * 5)
    root = f"file://{tmp_path}/store"
    first = Index(spark, root)
    first.ingest_documents(str(tmp_path / "a.pdf"))
    n, m = first.count(), first.edges().count()
    second = Index(spark, root, logs=str(tmp_path / "logs"))
    assert (second.version, second.count(), second.edges().count()) == (first.version, n, m)
    second.ingest_documents(str(tmp_path / "b.pdf"))
    assert second.list_documents() == ["a.pdf", "b.pdf"] and second.edges().count() > m
    with pytest.raises(VectorStoreError):  # made by the other one since
        first.ingest_documents(str(tmp_path / "b.pdf"))
    first.refresh()
    assert first.count() == second.count() == Index(spark, root).count() > n
    assert first.delete_document("a.pdf") == n and Index(spark, root).list_documents() == ["b.pdf"]
    assert "version" in (tmp_path / "logs" / "scriptorium.log").read_text()


def test_searches_that_can_find_nothing(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/store")
    with pytest.raises(RetrievalError, match="store"):
        index.search(["what?"])
    (tmp_path / "a.pdf").write_text("Volkswagen Group met Porsche Holding in Berlin today for a long talk about cars. " * 4)
    index.ingest_documents(str(tmp_path / "a.pdf"))
    for asked in (["  "], ["fine", None], []):
        with pytest.raises(RetrievalError, match="empty"):
            index.search(asked)
    assert index.search(["talk about cars", "Berlin"], 1).count() == 2


def test_edges_that_fail_leave_the_chunks(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("Volkswagen Group met Porsche Holding in Berlin today for a long talk about cars. " * 4)
    broken = Index(spark, f"file://{tmp_path}/store", extract=lambda t: F.transform(F.array(t), lambda x: F.array(F.struct(F.raise_error(F.lit("no model")).cast("string").alias("surface"), F.lit("ORG").alias("label")))))
    with pytest.raises(Exception, match="no model"):
        broken.ingest_documents(str(tmp_path / "a.pdf"))
    again = Index(spark, f"file://{tmp_path}/store")
    assert again.count() > 0 and again.edges().count() == 0


def test_labels_and_relations_of_a_model(spark):
    chunks = spark.createDataFrame([("c", "f.pdf", "1", "whatever")], "chunk_id string, source string, page string, text string")
    said = F.array(*[F.array(*[F.struct(F.lit(n).alias("surface"), F.lit(k).alias("label")) for n, k in s]) for s in ([("Ann", "PERSON"), ("Tuesday", "DATE"), ("Oslo", "GPE")], [("Bob", "PERSON"), ("ann", "PERSON")])])
    mentions = G.capitalised_mentions(chunks, lambda text: said)
    edges = G.build_edges(mentions, lambda a, b, head: F.when(b == "Oslo", F.lit("visit"))).orderBy("kind", "place_a", "place_b").collect()
    assert [(r.src, r.dst, r.relation, r.place_a, r.place_b) for r in edges] == [("Ann", "Oslo", "visit", 0, 1), ("Bob", "ann", "related_to", 2, 3), ("f", "Ann", "appears_in", 0, 0), ("f", "Oslo", "appears_in", 1, 0), ("f", "Bob", "appears_in", 2, 0)]
    assert [(r.pos, r.surface, r.label) for r in G.mention_rows(mentions).orderBy("pos").collect()][1] == (1, "Tuesday", "DATE")


def test_edges_need_no_shuffle(spark, capsys):
    G.build_edges(G.capitalised_mentions(spark.createDataFrame([("c", "f", "1", "Ann met Bob.")], "chunk_id string, source string, page string, text string"))).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_generators_and_selections(spark):
    asked = spark.createDataFrame([(1, "hello"), (2, "nothing")], "query_id int, question string")
    two = hits(spark).unionByName(hits(spark).withColumn("query_id", F.lit(2)))
    model = lambda prompts: prompts.withColumn("answer", F.when(F.col("query_id") == 1, F.concat(F.lit("said: "), F.right("prompt", F.lit(5)))))
    got = {r.query_id: (r.answer, r.status) for r in A.answered(asked, two, model).collect()}
    assert got == {1: ("said: hello", "ok"), 2: (None, "failed")}
    chosen = spark.createDataFrame([(1, "some text", "why?"), (7, "other", "why?")], "query_id int, selected string, question string")
    got = {r.query_id: r for r in A.selection_answers(chosen, hits(spark)).collect()}
    assert got[1].tool_used == "retriever" and got[1].answer.startswith("A sentence") and '"some text"' in got[1].request and got[1].n_sources == 3
    assert (got[7].answer, got[7].status, got[7].confidence) == (A.NO_SELECTION, "no_context", "Low")


def test_conversation_remembers_what_was_heard_to_the_end():
    prompts = []

    def complete(prompt):
        prompts.append(prompt)
        yield from ("one ", "two")

    talk = Conversation(complete)
    half = talk.stream("first?", [Passage("text")])
    assert next(half) == "one "
    half.close()
    assert talk.turns == []
    assert talk.ask("second?", []) == "one two" and A.NO_CONTEXT in prompts[-1]
    for k in range(4):
        talk.ask(f"q{k}?", [Passage("text")])
    assert prompts[-1].startswith("CONVERSATION HISTORY:\nUser: q0?\nAssistant: one two\n") and "Confidence: High\ntext\n" in prompts[-1]
    with pytest.raises(RetrievalError):
        talk.ask(" ", [])

    def fail(prompt):
        raise ValueError("down")

    with pytest.raises(GenerationError):
        Conversation(fail).ask("x", [])


def test_comparison_of_two_real_methods(spark):
    """Vector search and graph retrieval answer the same question, each scored on the contexts it found."""
    starts = spark.createDataFrame([(1, "D", 1)], "query_id int, node string, start_rank int")
    by_graph = G.graph_retrieve(small_graph(spark), starts, 2, 3).select(F.col("query_id").alias("qa_id"), "rank", V.hashed_embedding(F.col("chunk_text")).alias("vec"))
    by_vector = hits(spark).select(F.col("query_id").alias("qa_id"), "rank", V.hashed_embedding(F.col("text")).alias("vec"))
    qa = spark.createDataFrame([(1, "text 0", "text 1 and more", "text 2 and more"), (2, "x", "y", "z")], "qa_id int, question string, answer string, ground_truth string")
    per = None
    for method in ("vector", "graph"):
        found = E.evaluate(qa, E.retrieved_by(method, by_vector, by_graph).drop("method")).withColumn("method", F.lit(method))
        per = found if per is None else per.unionByName(found)
    asked = qa.select("qa_id", F.lit("t").alias("question_type"), F.explode(F.array(F.lit("vector"), F.lit("graph"))).alias("method"))
    got = {r.method: r for r in E.comparison(asked, per).collect()}
    assert got["graph"].zero_result_rate == got["vector"].zero_result_rate == 0.5 and got["graph"].context_precision > got["vector"].context_precision


def test_windows_of_requests(spark):
    from scriptorium.streaming import monitoring

    rows = [(1, "2024-01-01 10:00:00", "view", 1.0), (1, "2024-01-01 10:20:00", "error", 2.0), (1, "2024-01-01 11:00:00", "view", 3.0), (2, "2024-01-01 10:00:00", "view", 4.0)]
    events = spark.createDataFrame(rows, "user_id int, ts string, event_type string, value double")
    got = sorted((r.user_id, r.session_start[11:16], r.session_end[11:16], r.requests, r.errors) for r in monitoring.sessions(events).collect())
    assert got == [(1, "10:00", "10:50", 2, 1), (1, "11:00", "11:30", 1, 0), (2, "10:00", "10:30", 1, 0)]
    assert sorted((r.window_start[11:16], r.requests) for r in monitoring.sliding(events).collect()) == [("09:00", 3), ("10:00", 4), ("11:00", 1)]
    assert {r.window_start[11:16]: r.p95 for r in monitoring.latency_p95(events, approx=True).collect()} == {"10:00": 4.0, "11:00": 3.0}
    assert {r.window_start[11:16]: (r.error_rate, r.mean_latency) for r in monitoring.panels(events).collect()} == {"10:00": (0.333333, 2.333333), "11:00": (0.0, 3.0)}


def test_exact_means(spark):
    df = spark.createDataFrame([(x,) for x in (0.74375, 0.74375, None)], "x double")
    assert df.select(exact_mean(F.col("x"))).first()[0] == 0.7438
    assert df.select(exact_mean(-F.col("x"))).first()[0] == -0.7438
    assert df.where("x > 2").select(exact_mean(F.col("x"))).first()[0] is None


def test_files(spark, tmp_path):
    with pytest.raises(DocumentLoadError):
        files.document_pages(spark, [])
    assert issubclass(DocumentLoadError, EngineError)
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "ground_truth": "ä"}]))
    rows = files.read_json_rows(spark, str(tmp_path / "qa.json"))
    files.save_report(rows, str(tmp_path / "deep" / "r.json"))
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == [{"question": "q", "ground_truth": "ä"}]
    files.save_tables(f"file://{tmp_path}/t", edges=small_graph(spark))
    assert files.load_table(spark, f"file://{tmp_path}/t", "edges").count() == 7
