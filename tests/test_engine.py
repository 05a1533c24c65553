import io
import json
import os
import zipfile

import pytest

from tesserae.engine import Engine
from tesserae.sources.extract import Backend
from tesserae.streaming import feed
from tesserae.streaming.store import Snapshots

FILES = {
    "bread/rye.md": "---\ntags: [baking, grain]\n---\nopening words\n# Sour Dough\nleaven driven fermenting\n```\n# a line of code\n```\n## Kneading\ngluten stretches #slow-work\n",
    "bread/notes.md": "speaks of sour dough once, and kneading, and fermenting",
    "web/mill.html": "<html><style>p{}</style><script>var unseen='</p>'</script><p>Barley&amp;oats</p></html>",
    "oven.svg": "<svg><text x='1'>Hearthstone mark</text></svg>",
    "attic/old.md": "fermenting in the attic",
    ".private/key.md": "lockedword",
    "_shelf/list.txt": "underlined",
    "notes/jars.md": "# Jars\nGlass Vessels stand in rows.",
    "photos.md": "# Photos\nwords on the harvest\n![pic](https://u/pic.png)\n![dead](https://u/gone.png)",
    "ledger.docx": None,
    "torn.docx": "no zip",
    "talk.m4a": "audio bytes",
    "field.pdf": "First page\fHarrowing season report\f",
}


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body><w:p><w:r><w:t>mill</w:t></w:r><w:r><w:t>weir</w:t></w:r></w:p></w:body></w:document>")
    return out.getvalue()


def fetch(url: str) -> bytes:
    if "gone" in url:
        raise OSError("404")
    return b"Thistledown remote"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for path, text in FILES.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_bytes(docx() if text is None else text.encode())
    backend = Backend(pdf=lambda b: b.decode(), ocr=lambda b: b.decode(), speech=lambda b: "the sour dough  baker feeds a young leaven", fetch=fetch)
    out = Engine.open(spark, str(root), f"file:{tmp_path_factory.mktemp('store')}", ignore=["attic"], backend=backend, now_ms=1_700_000_000_000)
    out.refresh()
    return out


def found(engine, text, **options):
    return [f"{r.path}:{r.line}" if r.page == 0 else f"{r.path}:p{r.page}" for r in engine.search(text, **options).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("kneading", ["bread/rye.md:9", "bread/notes.md:0"]), ("leaven", ["bread/rye.md:4", "talk.m4a:0"]), ("slow", ["bread/rye.md:9"]), ("grain", ["bread/rye.md:0"]), ("fermenting path:notes", ["bread/notes.md:0"]),
        ("fermenting -path:notes", ["bread/rye.md:4"]), ("fermenting -once", ["bread/rye.md:4"]), ("barley ext:html", ["web/mill.html:0"]), ("barley in:image", []), ("unseen", []), ("hearthstone", ["oven.svg:0"]),
        ("attic", []), ("lockedword", []), ("underlined", ["_shelf/list.txt:0"]), ("millweir", ["ledger.docx:0"]), ("GlassVessels", ["notes/jars.md:0"]), ("harrowing", ["field.pdf:p2"]),
        ("leaven in:audio", ["talk.m4a:0"]), ("thistledown in:ocr", ["photos.md:0"]), ("torn", ["torn.docx:0"]),
    ],
)
def test_searches(engine, text, expected):
    assert found(engine, text) == expected


@pytest.mark.parametrize("text", ["fermentng", "frementing", "leavn driven", "sour duogh", "GlassVesselx"])
def test_typos_are_corrected(engine, text):
    assert found(engine, text) and engine.corrected


def test_no_needless_correction(engine):
    assert found(engine, "fermenting") and not engine.corrected
    assert not found(engine, "zzzzqqqq") and not engine.corrected


def test_scope(engine):
    assert found(engine, "fermenting", scope=["bread/notes.md"]) == ["bread/notes.md:0"]


def test_status_and_ask(engine):
    assert engine.status()["counts"] == {"pending": 0, "ocr": 0, "done": 10, "error": 1}
    asked = []
    answer, sources = engine.ask("How does the Kneading gluten work?", lambda i, p: asked.append(p) or " fine [1] ")
    assert answer == "fine [1]" and sources[0].path == "bread/rye.md" and "[1] (bread/rye.md)" in asked[0] and asked[0].endswith("work?")
    assert engine.ask("what zzzzqqqq", lambda i, p: "x")[1] == []
    with pytest.raises(ValueError):
        engine.ask("  ", lambda i, p: "x")


def test_search_does_not_read_texts_to_find_words(engine):
    from tesserae.plans import search
    from tesserae.plans.query import parse

    plan = search.ranked(search.hits(engine.tables(), parse("fermenting leaven"), 0), 50)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "body" not in plan and "StartsWith" in plan
    got = engine.search("fermenting")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rowid" in got


def state(engine):
    """The index's tables as they should be: built from the chunks, and as they are."""
    from tesserae.operators import index

    tables = engine.tables()
    rows = lambda df: sorted(map(str, df.collect()))
    posts = index.postings(tables.chunks)
    want = rows(posts), rows(index.vocabulary(posts)), rows(index.corpus_stats(index.doc_stats(tables.chunks)))
    return want, (rows(tables.postings.select(posts.columns)), rows(tables.vocab), rows(tables.stats))


TREES = ["alders", "birches", "cedars", "dogwood", "elderberry", "firewood", "ginkgo", "hazelnut", "ironwood"]


def test_changes_of_a_file_leave_the_built_index(spark, tmp_path, monkeypatch):
    from tesserae import engine as module

    monkeypatch.setattr(module, "REBUILD", 1.5)
    root = tmp_path / "vault"
    root.mkdir()
    for i in range(9):
        (root / f"n{i}.md").write_text(f"common words of {TREES[i]}\n# Part\nmore of it")
    one = Engine.open(spark, str(root), f"file:{tmp_path / 'store'}", backend=Backend(), now_ms=0)
    one.refresh()
    built = one.store.read("postings").inputFiles()
    assert state(one)[0] == state(one)[1]
    (root / "n3.md").write_text("other words altogether")
    os.remove(root / "n4.md")
    (root / "new.md").write_text("common and new")
    one.refresh()
    want, got = state(one)
    assert want == got and one.store.read("postings").inputFiles() == built
    assert found(one, "altogether") == ["n3.md:0"] and not found(one, "dogwood") and not found(one, "elderberry") and found(one, "common new") == ["new.md:0"]
    feed_rows = [(1, "rename", "moved/x.md", "n5.md", None, None, None), (2, "delete", "n6.md", None, None, None, None)]
    one.apply_changes(spark.createDataFrame(feed_rows, "seq bigint, op string, path string, old_path string, kind string, mtime bigint, size bigint"))
    want, got = state(one)
    assert want == got and found(one, "firewood") == ["moved/x.md:0"] and not found(one, "ginkgo") and one.store.read("postings").inputFiles() == built
    for i in (0, 1, 2):
        (root / f"n{i}.md").write_text(f"again {i}")
    os.makedirs(root / "moved")
    os.rename(root / "n5.md", root / "moved/x.md")
    os.remove(root / "n6.md")
    one.refresh()
    want, got = state(one)
    assert want == got and one.store.read("postings").inputFiles() != built


def test_a_root_with_a_scheme(spark, tmp_path):
    from tesserae.sources import vault

    (tmp_path / "in" / ".dot").mkdir(parents=True)
    for path, text in {"a.md": "one", "in/b.txt": "two", "in/c.zzz": "no kind", "in/.dot/d.md": "hidden"}.items():
        (tmp_path / path).write_text(text)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        files = vault.listing(spark, root)
        assert {(r.path, r.kind, r.size) for r in files.collect()} == {("a.md", "text", 3), ("in/b.txt", "text", 3)}
        both = files.select("path").union(spark.createDataFrame([("gone.md",)], "path string"))
        assert {r.path: r.content and bytes(r.content) for r in vault.contents(both, root).collect()} == {"a.md": b"one", "in/b.txt": b"two", "gone.md": None}


def test_settings(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault" / "a.png").write_bytes(b"x")
    one = Engine.open(spark, str(tmp_path / "vault"), f"file:{tmp_path / 'store'}", backend=Backend(ocr_in=lambda b, codes: f"seen {codes}"), now_ms=0)
    one.configure('{"ignore": "/drafts/\\n", "ocrLang": "en"}')
    one.refresh()
    assert one.ignore == ["drafts"] and found(one, "eng") == ["a.png:0"]
    one.configure('{"ocrLang": "de, fr"}')
    assert one.status()["counts"]["ocr"] == 1
    one.extract("ocr")
    assert found(one, "deu") == ["a.png:0"] and not found(one, "eng")
    one.configure('{"ocrLang": "de,fr"}')
    assert one.status()["counts"]["ocr"] == 0


ROW = "id bigint, path string, kind string, mtime bigint, size bigint, status string, error string"
CHANGE = "seq bigint, op string, path string, old_path string, kind string, mtime bigint, size bigint"


@pytest.mark.parametrize(
    ("known", "batch", "after"),
    [
        ([], [("insert", "a.md", None), ("rename", "b.md", "a.md")], ["b.md"]),
        (["a.md"], [("delete", "a.md", None), ("insert", "c.md", None), ("rename", "a.md", "c.md")], ["a.md"]),
        (["dir/a.md", "dir/sub/b.md", "dirty.md"], [("delete", "dir", None)], ["dirty.md"]),
        (["dir/a.md"], [("delete", "dir", None), ("insert", "dir/b.md", None)], ["dir/b.md"]),
        (["dir/a.md"], [("insert", "dir/b.md", None), ("delete", "dir", None), ("insert", "dir/a.md", None)], ["dir/a.md"]),
        (["a/x.md", "b/y.md"], [("rename", "c", "a"), ("rename", "a", "b"), ("update", "a/y.md", None), ("delete", "c", None)], ["a/y.md"]),
        (["a.md"], [("insert", "../out.md", None), ("rename", ".hid/a.md", "a.md")], ["a.md"]),
    ],
)
def test_order_of_changes(spark, tmp_path, known, batch, after):
    store = Snapshots(spark, f"file:{tmp_path}")
    store.write({"files": spark.createDataFrame([(i + 1, p, "text", 1, 1, "done", "") for i, p in enumerate(known)], ROW)})
    rows = [(i, op, path, old, "text", 2, 2) for i, (op, path, old) in enumerate(batch)]
    feed.apply_batch(store)(spark.createDataFrame(rows[::-1], CHANGE), 0)
    assert sorted(r.path for r in store.read("files").collect()) == after


def test_old_versions_go(spark, tmp_path):
    store = Snapshots(spark, f"file:{tmp_path}", keep=2)
    for i in range(5):
        store.write({"t": spark.range(i)} | ({"u": spark.range(1)} if i == 0 else {}))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("v*/*")) == ["v1/u", "v4/t", "v5/t"] and store.read("t").count() == 4 and store.read("u").count() == 1


def test_changes_and_streams(engine, spark, tmp_path):
    files = engine.store.read("files")
    before = files.where("path = 'bread/notes.md'").first()
    folder = tmp_path / "feed"
    folder.mkdir()
    rows = [{"seq": 1, "op": "rename", "path": "bread/moved.md", "old_path": "bread/notes.md"}, {"seq": 2, "op": "delete", "path": "oven.svg"}, {"seq": 3, "op": "update", "path": "photos.md", "kind": "text", "mtime": 5, "size": 6}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    feed.follow(spark, str(folder), engine.store, str(tmp_path / "checkpoint"), seconds=None).awaitTermination()
    after = {r.path: r for r in engine.store.read("files").collect()}
    assert after["bread/moved.md"].id == before.id and "bread/notes.md" not in after and "oven.svg" not in after
    assert after["photos.md"].status == "pending"
    version = engine.store.version()
    feed.apply_batch(engine.store)(spark.createDataFrame([], "seq bigint, op string, path string, old_path string, kind string, mtime bigint, size bigint"), engine.store.batch())
    assert engine.store.version() == version  # a batch that comes again changes nothing
    engine._index = None
    assert found(engine, "once") == ["bread/moved.md:0"]


def test_reset(engine):
    engine.reset()
    assert engine.store.read("files").count() == engine.store.read("chunks").count() == engine.store.read("memo").count() == 0
