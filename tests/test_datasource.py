"""The data source of paged documents: pages of cut files, pushed filters, and a stream that ingest reads from."""

import io
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.splitter import fixed_split
from scriptorium.operators import chunking as C
from scriptorium.operators import graph as G
from scriptorium.sources import datasource as D
from scriptorium.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("documents")
    (out / "below").mkdir()
    rng = random.Random(4)
    for k in range(6):
        pages = ["" if rng.random() < 0.2 else f"Ada Lovelace wrote page {p} of file {k}. " * rng.randint(1, 40) + "ü€" for p in range(rng.randint(1, 30))]
        (out / ("below" if k % 2 else ".") / f"file_{k}.{'TXT' if k % 3 else 'md'}").write_text("\f".join(pages), encoding="utf-8", newline="")
    (out / "_hidden.txt").write_text("no")
    (out / "empty.txt").write_text("")
    return out


def plain(folder):
    rows = []
    for path in folder.rglob("*.*"):
        if not path.name.startswith("_"):
            for k, page in enumerate(path.read_bytes().decode().split("\f"), 1):
                if page.strip():
                    rows.append((path.name, path.suffix.lower(), str(k), k, page))
    return sorted(rows)


@pytest.mark.parametrize("size", [300, 4096, 1 << 25])
def test_every_page_is_read_once_however_files_are_cut(spark, folder, size):
    D.register(spark)
    df = spark.read.format("paged_documents").option("path", f"file://{folder}").option("partitionBytes", size).load()
    assert sorted(map(tuple, df.drop("modified").collect())) == plain(folder)
    assert (df.rdd.getNumPartitions() > 20) == (size == 300)


def test_ranges_of_random_texts():
    rng = random.Random(8)
    for _ in range(300):
        raw = b"".join(rng.choice([b"a", b"bc", b"\f", "é".encode(), b"\f\f"]) for _ in range(rng.randint(0, 40)))
        cuts = sorted({0, len(raw), *(rng.randint(0, len(raw)) for _ in range(3))})
        got = [p for a, b in zip(cuts, cuts[1:], strict=False) for p in D.range_pages(io.BytesIO(raw), a, b)]
        want = [(k, t.decode()) for k, t in enumerate(raw.split(b"\f"), 1)]
        assert [g for g in got if g[1]] == [w for w in want if w[1]]


def test_filters_go_to_the_listing(spark, folder, capsys):
    D.register(spark)
    df = spark.read.format("paged_documents").option("path", str(folder)).load()
    md = df.where("suffix = '.md' and page_num > 1")
    assert sorted(map(tuple, md.drop("modified").collect())) == [r for r in plain(folder) if r[1] == ".md" and r[3] > 1]
    md.explain()
    out = capsys.readouterr().out
    assert "Filter" in out and "suffix" not in out.split("Filter")[1].split("\n")[0]  # Spark keeps the other condition alone
    named = df.where(F.col("source").endswith("_4.TXT") | F.lit(False))
    assert {r.source for r in named.collect()} == {"file_4.TXT"}
    reader = D.Reader({"path": str(folder)})
    left = list(reader.pushFilters([D.EqualTo(("suffix",), ".txt"), D.StringStartsWith(("source",), "file_"), D.EqualTo(("page",), "1"), D.In(("source",), ("file_1.TXT", "file_2.TXT", "x"))]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [f[2] for f in reader.listing.files()] == sorted(["file_1.TXT", "file_2.TXT"], key=lambda n: [f[2] for f in D.Listing({"path": str(folder)}).files()].index(n))
    with pytest.raises(Exception, match="nothing at"):
        spark.read.format("paged_documents").option("path", f"{folder}/nowhere").load().count()


def test_stream_ingest_reads_from_it(spark, folder, tmp_path):
    D.register(spark)
    to_chunks = lambda df: C.process_pages(df.select("source", "page", "raw_text"), fixed_split)
    own = tmp_path / "in"
    own.mkdir()

    def run():
        stream = spark.readStream.format("paged_documents").option("path", str(own)).load()
        ingest.ingest(stream, f"file://{tmp_path}/out", to_chunks, lambda df: G.build_edges(G.capitalised_mentions(df))).awaitTermination()
        return {r.chunk_id for r in ingest.VersionedTable(spark, f"file://{tmp_path}/out/chunks", ingest.CHUNKS, "chunk_id").newest().collect()}

    files = sorted(p for p in folder.rglob("file_*"))
    for p in files[:3]:
        (own / p.name).write_bytes(p.read_bytes())
    first = run()
    for p in files[3:]:
        (own / p.name).write_bytes(p.read_bytes())
    both = run()
    batch = to_chunks(spark.read.format("paged_documents").option("path", str(folder)).load().where("source like 'file%'"))
    assert first < both and both == {r.chunk_id for r in batch.collect()}


def test_adapters_of_decoders_and_ocr(spark, tmp_path):
    from scriptorium.sources import files

    for k in range(40):
        (tmp_path / f"i{k}.{'PNG' if k % 2 else 'gif'}").write_bytes(b"bad" if k == 7 else b"blank" if k == 8 else f"image {k}".encode())
    (tmp_path / "d.pdf").write_bytes(b"one|two||four")

    def model(images, kinds, prompt, most):
        import base64

        texts = [base64.b64decode(x).decode() for x in images]
        if "bad" in texts:
            raise ValueError("can't see")
        return [" " if t == "blank" else f"{prompt}:{most}:{kind}:{t}" for t, kind in zip(texts, kinds, strict=True)]

    images = files.image_texts(spark, [f"file://{tmp_path}/*.PNG", f"file://{tmp_path}/*.gif"], files.batched_ocr(model, "read", 77))
    got = {r.source: (r.text, r.status) for r in images.collect()}
    assert len(got) == 40 and got["i3.PNG"] == ("read:77:image/png:image 3", "success") and got["i4.gif"][0] == "read:77:image/gif:image 4"
    assert got["i7.PNG"] == (None, "error: no text") and got["i8.gif"][1] == "error: no text" and sum(s == "success" for _, s in got.values()) == 38
    pages = files.document_pages(spark, f"file://{tmp_path}/d.pdf", files.batched_decoder(lambda raw: raw.decode().split("|")))
    assert [(r.page_num, r.raw_text) for r in pages.orderBy("page_num").collect()] == [(1, "one"), (2, "two"), (4, "four")]
    with pytest.raises(Exception, match="a document can't be read: no PDF"):
        files.document_pages(spark, f"file://{tmp_path}/d.pdf", files.batched_decoder(lambda raw: (_ for _ in ()).throw(ValueError("no PDF")))).collect()
