"""Folders to corpora: inventory, decision, sinks, command line, configuration, streaming."""

import json
import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestack import cli, config
from lodestack.functions import columns as C
from lodestack.i18n import format_number, t
from lodestack.operators import assembly, inventory
from lodestack.plans import analysis, catalogue
from lodestack.selection import InputSelection
from lodestack.sources.readers import safe_read
from lodestack.streaming.progress import ProgressEmitter, ProgressEvent

from . import builders

NOW = datetime(2024, 1, 2, 3, 4, 5)
LONG = "Une phrase assez longue pour que le fichier ne passe pas pour une image. " * 2


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "subdir").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, body in {"doc10.txt": LONG, "doc2.txt": LONG, "notes.md": LONG + "```x```", "_under.txt": LONG, "B.TXT": LONG, "program.exe": "x", "~$locked.docx": "x", "photo.jpg": "x", "subdir/deep.txt": LONG, ".git/no.txt": LONG, "bad.json": "{", "short.txt": "x"}.items():
        (root / name).write_text(body, encoding="utf-8")
    (root / "img.html").write_text(f"<p>{LONG}</p><img><img alt=a>", encoding="utf-8")
    return root


def names(df, column="relative_path"):
    return [r[column] for r in df.orderBy("ord").collect()]


def test_inventory(spark, folder):
    files, out = inventory.collect_inputs(spark, folder)
    assert names(files) == ["_under.txt", "B.TXT", "bad.json", "doc2.txt", "doc10.txt", "img.html", "notes.md", "short.txt", "subdir/deep.txt"]
    assert [r.ord for r in files.orderBy("ord").collect()] == list(range(9))
    assert {r["name"]: r["reason_code"] for r in out.collect()} == {"program.exe": "unsupported", "~$locked.docx": "special", "photo.jpg": "image"}
    assert "OCR" in out.where("name = 'photo.jpg'").first().reason
    flat, _ = inventory.collect_inputs(spark, folder, recursive=False, exclude=("doc*",), extensions=(".txt",))
    assert names(flat) == ["_under.txt", "B.TXT", "short.txt"]
    assert "subdir/deep.txt" not in names(inventory.collect_inputs(spark, folder, max_depth=0)[0])
    by_type = names(inventory.collect_inputs(spark, folder, sort="type")[0])
    assert by_type[:3] == ["img.html", "bad.json", "notes.md"] and by_type[-1] == "subdir/deep.txt"
    os.utime(folder / "doc10.txt", (2_000_000_000, 2_000_000_000))
    assert names(inventory.collect_inputs(spark, folder, sort="mtime")[0])[0] == "doc10.txt"
    with pytest.raises(NotADirectoryError):
        from lodestack.sources.folders import list_folder

        list_folder(spark, str(folder / "doc2.txt"))


def test_several_sources(spark, tmp_path):
    for d in ("premier", "second"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "document.txt").write_text(LONG)
    a, b = tmp_path / "premier", tmp_path / "second"
    assert names(inventory.collect_inputs(spark, [a, b])[0]) == ["premier/document.txt", "second/document.txt"]
    assert names(inventory.collect_inputs(spark, [a, a / "document.txt"])[0]) == ["premier/document.txt"]
    both = inventory.collect_inputs(spark, [a / "document.txt", b / "document.txt"])[0]
    assert sorted(names(both)) == ["document.txt", "second/document.txt"]
    files, out = inventory.collect_inputs(spark, InputSelection.of([a, b]).exclude(a / "document.txt"))
    assert names(files) == ["second/document.txt"]
    assert [(r["name"], r["reason_code"]) for r in out.collect()] == [("document.txt", "removed")]
    assert names(inventory.collect_inputs(spark, [a / "document.txt"])[0]) == ["document.txt"]


def test_labels_take_longer_ends_then_numbers():
    assert inventory.unique_labels([("/a/x/f", "f"), ("/b/x/F", "F"), ("/c/x/f", "f")], {"b/x/f"}) == {"/a/x/f": "f", "/b/x/F": "x/F", "/c/x/f": "c/x/f"}
    assert inventory.unique_labels([("f", "f"), ("f2", "f"), ("f3", "f")], {"f2"}) == {"f": "f", "f2": "f (2)", "f3": "f (3)"}


def test_labels_come_from_joins_alone(spark, sf_dir, monkeypatch):
    rows = [(0, f"/{a}/{b}/{c}", "y/f" if a + b == "Yx" else "f") for a in "xY" for b in "xyX" for c in ("f", "F", "g")]
    rows += [(1, "/q/f", "f"), (1, "/r/y/f", "y/f"), (1, "/s/y/f", "Y/F"), (2, "/only", "x/g"), (0, "h", "h"), (0, "h2", "h"), (0, "h3", "H")]
    ranked = inventory.ordinals(spark.createDataFrame(rows, "source_idx int, path string, preferred string"), [F.col("source_idx"), C.natural_key(F.col("preferred")), F.col("path")])
    lower = [p.lower() for _, _, p in rows]
    ordered = [(r.path, r.preferred) for r in ranked.orderBy("ord").collect() if lower.count(r.preferred.lower()) > 1]
    want = {path: p for _, path, p in rows} | inventory.unique_labels(ordered, {p for p in lower if lower.count(p) == 1})
    monkeypatch.setattr(inventory, "unique_labels", None)
    assert {r.path: r.relative_path for r in inventory.labelled(spark.createDataFrame(rows, "source_idx int, path string, preferred string")).collect()} == want
    pages = [r.relative_path for r in catalogue.queries()["unique_labels"](spark, sf_dir).collect()]
    assert len(set(pages)) == len(pages) and all(p.endswith("page.html") for p in pages)


def test_selection():
    s = InputSelection.of(["a", "b", "./a"])
    assert [p.name for p in s.paths] == ["a", "b"] and s.primary_path == Path("a")
    assert s.exclude("b").is_excluded("./b") and not s.exclude("b").add(["b"]).is_excluded("b")
    with pytest.raises(ValueError):
        InputSelection.of([])


def test_analysis_and_recomputation(spark, folder, tmp_path):
    r = analysis.run_analysis(spark, folder)
    status = {x.relative_path: x.status for x in r.files.collect()}
    assert status["bad.json"] == "error" and status["short.txt"] == "low_text" and status["img.html"] == "images" and status["doc2.txt"] == "ready"
    assert r.decided.n_files == 9 and not r.is_blocked and r.n_ignored == 3 and r.block_reason is None
    first = {x.relative_path: x.tokens_with_margin for x in r.files.collect()}
    assert first["bad.json"] == 0
    r.recompute_limit(60)
    assert r.is_blocked and r.decided.first_blocking == "_under.txt" and "(" in r.block_reason
    assert r.files.where("relative_path = 'img.html'").first().status == "too_large"
    r.recompute_limit(300)
    assert r.is_blocked and r.decided.n_blocking == 0
    assert r.block_reason == t("summary.blocked_total", total=format_number(r.decided.tokens_with_margin), limit=format_number(300))
    r.recompute_limit(10**6).recompute_engine("mistral")
    assert not r.is_blocked and r.engine_id == "approx"
    assert {x.relative_path: x.tokens_with_margin for x in r.files.collect()} == first
    assert r.files.where("relative_path = 'img.html'").first().status == "images" and r.count_base_status("images") == 1
    before = r.decided.bytes_utf8
    assert r.remove_file(folder / "doc2.txt", "retiré") and not r.remove_file("nothing")
    assert r.decided.n_files == 8 and r.decided.bytes_utf8 < before and r.n_ignored == 4
    assert sum(r.summary().values()) == 8


def test_corpus_bytes(spark, folder, tmp_path):
    r = analysis.run_analysis(spark, folder)
    out = tmp_path / "o" / "corpus.md"
    assert analysis.generate_corpus(r, out, now=NOW)
    raw = out.read_bytes()
    text = raw.decode()
    assert text.startswith("# Corpus\n\n- **Généré le** : 2024-01-02 03:04:05\n") and "\n\n---\n\n---\n## SOURCE: _under.txt\n- type: txt\n" in text
    assert "- **Fichiers** : 9\n" in text and text.count("## SOURCE: ") == 8 and "bad.json" not in text
    assert f"---\n\n````\n{LONG}```x```\n````\n\n---\n" in text and text.endswith("\n\n---\n")
    for x in r.files.where("status in ('ready', 'images', 'low_text')").collect():
        head = text[text.index(f"---\n## SOURCE: {x.relative_path}\n") :].split("\n---\n", 1)[0] + "\n---"
        assert len(f"{head}\n\n{x.text}".encode()) == x.bytes_utf8
    analysis.generate_corpus(r, tmp_path / "c.md", "crlf", NOW)
    assert (tmp_path / "c.md").read_bytes().count(b"\r\n") > 20
    r.estimated = r.estimated.repartition(7)
    analysis.generate_corpus(r, tmp_path / "again.md", now=NOW)
    assert (tmp_path / "again.md").read_bytes() == raw
    assembly.write_distributed(r, str(tmp_path / "parts"))
    assert sum("## SOURCE" in p.read_text() for p in (tmp_path / "parts").glob("part-*")) >= 1
    report = json.loads((tmp_path / "o" / "corpus_rapport.json").read_text())
    assert report["total_files"] == 9 and report["total_ignored"] == 3 and len(report["files"]) == 9 and len(report["ignored"]) == 3
    assert [f["relative_path"] for f in report["files"]] == names(r.files) and "text" not in report["files"][0]
    md = (tmp_path / "o" / "corpus_rapport.md").read_text()
    assert "| doc2.txt | txt | " in md and "## Erreurs\n\n- **bad.json** : " in md and "| photo.jpg | Fichier image" in md
    with pytest.raises(ValueError):
        analysis.generate_corpus(r, tmp_path / "c.docx")


def test_pdf_corpus_can_be_read_back(spark, folder, tmp_path):
    r = analysis.run_analysis(spark, folder)
    assert analysis.generate_corpus(r, tmp_path / "c.pdf", now=NOW)
    found = safe_read((tmp_path / "c.pdf").read_bytes(), ".pdf")
    assert found.status == "ready" and found.page_count == 9 and "## SOURCE: subdir/deep.txt" in found.text and "Une phrase assez longue" in found.text


def test_exact_payload(spark, tmp_path):
    (tmp_path / "accentué.txt").write_text("é" * 100, encoding="utf-8")
    r = analysis.run_analysis(spark, tmp_path)
    x = r.files.first()
    want = f"---\n## SOURCE: accentué.txt\n- type: txt\n- taille_octets: 200\n- tokens_estimes: {x.tokens_estimated}\n- tokens_avec_marge: {x.tokens_with_margin}\n- encodage: utf-8\n---\n\n" + "é" * 100
    assert x.bytes_utf8 == len(want.encode()) and x.tokens_estimated == -(-x.bytes_utf8 // 4)


def test_office_files_in_a_folder(spark, tmp_path):
    for name in ("docx", "pptx", "xlsx", "odt", "pdf"):
        (tmp_path / f"a.{name}").write_bytes(getattr(builders, name)())
    rows = analysis.run_analysis(spark, tmp_path).files.collect()
    assert {r.file_type for r in rows} == {"docx", "pptx", "xlsx", "odt", "pdf"} and all(r.status != "error" and "�" not in r.text for r in rows)


@pytest.mark.parametrize("limit", [128_000, 400_000])
def test_three_big_files(spark, tmp_path, limit, capsys):
    for i in range(3):
        (tmp_path / f"doc_{i}.txt").write_text("A" * 200_000)
    code = cli.main(["-i", str(tmp_path), "-o", str(tmp_path / "out"), "-c", str(limit), "--yes"], spark)
    assert code == (cli.BLOCKED if limit == 128_000 else cli.OK)
    assert (tmp_path / "out" / "corpus.md").exists() == (code == cli.OK)
    assert (tmp_path / "out" / "corpus_rapport.json").exists() and (tmp_path / "out" / "corpus_rapport.md").exists()


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    assert cli.main(["--list-formats"]) == 0 and ".docx" in capsys.readouterr().out
    assert cli.main(["--list-tokenizers"]) == 0 and "approx" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0
    assert cli.main([]) == cli.WRONG and cli.main(["-i", "/nowhere"]) == cli.WRONG
    empty = tmp_path / "empty"
    empty.mkdir()
    assert cli.main(["-i", str(empty), "-o", str(tmp_path / "o1")], spark) == cli.NO_FILES
    assert cli.main(["-i", str(folder), "-o", str(folder / "doc2.txt" / "x")], spark) == cli.NOT_WRITABLE
    out = tmp_path / "dry" / "c.md"
    assert cli.main(["-i", str(folder), "-o", str(out), "--dry-run", "--report", str(tmp_path / "r.json"), "--lang", "en"], spark) == cli.OK
    assert not out.exists() and (tmp_path / "r.json").exists() and (tmp_path / "r.md").exists()
    assert cli.main(["-i", str(folder), "-o", str(out), "--dry-run", "-c", "10"], spark) == cli.BLOCKED
    assert cli.main(["-i", str(folder), "-o", str(out), "--include-ext", "md", "--format", "pdf", "--force-images"], spark) == cli.OK
    assert out.read_text().count("## SOURCE") == 1


def test_output_paths(tmp_path):
    assert cli.output_path("x.pdf", "md", tmp_path).name == "x.pdf"
    assert cli.output_path("dir", "pdf", tmp_path) == Path("dir/corpus.pdf")
    assert cli.output_path(None, "md", tmp_path) == tmp_path / "lodestack_output" / "corpus.md"
    assert analysis.report_paths(Path("a/c.md")) == (Path("a/c_rapport.md"), Path("a/c_rapport.json"))
    assert analysis.report_paths(Path("c.md"), Path("r.json")) == (Path("r.md"), Path("r.json"))


def test_configuration(tmp_path, monkeypatch):
    own, user = tmp_path / "own", tmp_path / "user"
    monkeypatch.setattr(config, "program_dir", lambda: own)
    monkeypatch.setattr(config, "user_dir", lambda: user)
    assert config.load_config() == config.Config()
    config.save_config(config.Config(margin=0.3), user / "lodestack.json")
    assert config.load_config().margin == 0.3
    own.mkdir()
    (own / "lodestack.json").write_text("{broken")
    assert config.load_config().margin == 0.3
    (own / "lodestack.json").write_text('{"context_limit": 5, "unknown": 1, "scan": {"min_chars_file": 3}}')
    assert (config.load_config().context_limit, config.load_config().scan.min_chars_file) == (5, 3)
    assert config.save_config(config.Config()).parent == own
    bad = config.Config(context_limit=0, margin=2, format="x", sort="x", max_depth=0, tokenizer_engine="x", scan=config.ScanConfig(-1, 0, 0, 2))
    assert len(bad.validate()) == 7 and config.Config().validate() == []


def test_progress(spark, folder):
    emitter = ProgressEmitter()
    analysis.run_analysis(spark, folder, emitter=emitter)
    events = emitter.drain()
    assert [e.status for e in events].count("pending") == 9 and len(events) == 18 and emitter.drain() == []
    emitter.cancel()
    emitter.emit(ProgressEvent("x", 1, 1, "ready"))
    assert emitter.is_cancelled() and emitter.drain() == []


class StopsAfter(ProgressEmitter):
    """Cancels itself at the n-th file that ends."""

    def __init__(self, n):
        super().__init__()
        self.left, self.seen = n, []

    def emit(self, event):
        if event.status != "pending" and not self.is_cancelled():
            self.seen.append(event.file_path)
            self.left -= 1
            if not self.left:
                self.cancel()
        super().emit(event)


def test_cancelling_keeps_what_was_read(spark, folder, monkeypatch):
    monkeypatch.setattr(analysis, "FILES_A_PART", 1)
    monkeypatch.setattr(analysis, "WORKERS", 1)
    all_files = {r.path for r in analysis.run_analysis(spark, folder).files.collect()}
    emitter = StopsAfter(4)
    result = analysis.run_analysis(spark, folder, emitter=emitter)
    got = {r.path for r in result.files.collect()}
    assert got < all_files and got <= set(emitter.seen) and len(got) >= 1
    assert result.decided.n_files == len(got)
    assert spark.range(5).count() == 5
    at_once = ProgressEmitter()
    at_once.cancel()
    assert analysis.run_analysis(spark, folder, emitter=at_once).files.count() == 0


def test_stream_totals_equal_the_batch(spark, sf_dir, tmp_path):
    from lodestack.operators import budget
    from lodestack.sources import tables
    from lodestack.streaming import totals

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = totals.running_totals(totals.document_stream(spark, str(tmp_path / "in")), 8000)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("totals").first()
    want = budget.corpus_totals(budget.with_estimate(budget.with_status(tables.as_text_files(docs)))).first()
    assert (got.n_files, got.bytes_utf8, got.tokens_with_margin) == (want.n_files, want.bytes_utf8, want.tokens_with_margin)


def test_queries_equal_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    sql = catalogue.oracle_sql()
    for name, q in catalogue.queries().items():
        got = q(spark, sf_dir)
        rows = sorted(map(repr, got.select(*sorted(got.columns)).collect()))
        if name in sql:
            found = con.execute(sql[name])
            columns = [d[0] for d in found.description]
            order = sorted(range(len(columns)), key=columns.__getitem__)
            want = sorted(f"Row({', '.join(f'{columns[i]}={r[i]!r}' for i in order)})" for r in found.fetchall())
            assert rows == want, name
        else:
            assert rows, name
