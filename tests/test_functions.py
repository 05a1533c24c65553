import http.server
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import changes, sections
from tesserae.plans import search
from tesserae.sources import extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance(spark):
    rng = random.Random(7)
    pairs = [("", "abc"), ("abc", "abc"), ("abc", "acb"), ("kitten", "sitting"), ("schedulng", "scheduling"), ("ca", "abc")]
    pairs += [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa("a", "b").alias("d")).collect()
    assert all(r.d == plain_osa(r.a, r.b) for r in got)
    assert [plain_osa(*p) for p in pairs[:6]] == [3, 0, 1, 3, 1, 3]


@pytest.mark.parametrize("path, kind, stem", [("a/b.c/Note.One.MD", "text", "Note.One"), ("x.PNG", "image", ""), ("dir.md/none", None, "none"), ("r.docx", "ooxml", "r"), ("s.svg", "html", "s"), ("v.mov", "audio", "")])
def test_paths(spark, path, kind, stem):
    assert one(spark, T.kind_of(F.lit(path))) == kind
    assert one(spark, T.stem(F.lit(path), F.coalesce(T.kind_of(F.lit(path)), F.lit("")))) == stem


@pytest.mark.parametrize("setting, codes", [("", "eng"), ("en-US", "eng"), ("auto", "eng"), ("en-US,xx-YY", "eng"), ("eng", "eng"), ("zh-Hant, de", "chi_tra+deu")])
def test_languages(spark, setting, codes):
    assert one(spark, T.recognition_languages(F.lit(setting))) == codes


def test_small_functions(spark):
    assert one(spark, T.recognition_languages(F.lit("en,de"), ["deu"])) == "deu"
    assert one(spark, T.latin(F.lit("ВТ"), F.lit("en-US"))) == "BT" and one(spark, T.latin(F.lit("ВТ"), F.lit("ru-RU"))) == "ВТ"
    assert one(spark, T.vault_key(F.lit("/notes/Work"))) != one(spark, T.vault_key(F.lit("/other/Work")))
    assert [one(spark, T.valid_path(F.lit(p))) for p in ("a/b.md", "../x", "a/.b", "/abs")] == [True, False, False, False]
    assert one(spark, search.pack(F.lit(3), F.lit(7))) == (3 << 20) + 7
    assert one(spark, T.shown(F.lit("a \x02b\x03\n c"))) == "a [b] c"


def test_sections_and_lines(spark):
    note = "---\ntags: [kernel, cpu]\n---\nintro\n# Round Robin ##\nx\n```\n# no\n```\n\n## Priority\n#hard-topic y\n# \n"
    got = sections.sections(spark.createDataFrame([(1, note), (2, None)], "id long, text string")).orderBy("id", "page").collect()
    assert [(r.id, r.page, r.title) for r in got] == [(1, 1, "kernel cpu"), (1, 5, "Round Robin"), (1, 11, "Priority hard-topic"), (1, 13, ""), (2, 1, "")]
    boxes = spark.createDataFrame([(1, "b", 5.0, 9.0, 2.0), (1, "a", 1.0, 9.4, 2.0), (1, "c", 0.0, 3.0, 2.0)], "image int, text string, x double, mid double, height double")
    assert sections.box_lines(boxes).first().text == "a b\nc"


def test_settings_and_changes(spark):
    setting = F.lit('{"ignore": " /Templates/ \\n\\nold/x\\n", "ocrLang": "en"}')
    assert one(spark, extract.ignore_list(setting)) == ["Templates", "old/x"]
    files = spark.createDataFrame([(1, "a.png", "image", 1, 1, "done", ""), (2, "b.pdf", "pdf", 1, 1, "done", "")], "id long, path string, kind string, mtime long, size long, status string, error string")
    assert changes.requeue_media(files, "en", "en").where("status = 'ocr'").count() == 0
    assert [r.path for r in changes.requeue_media(files, "en", "hi-IN").where("status = 'ocr'").collect()] == ["a.png"]
    meta = spark.createDataFrame([("ocr", "app|en-US|1"), ("x", "y")], "key string, value string")
    assert {(r.key, r.value) for r in changes.upgraded_settings(meta).collect()} == {("media", "en-US"), ("x", "y")}
    claimed = []
    for _ in range(2):
        claimed.append(changes.next_jobs(files, "done", claimed).first().id)
    assert claimed == [1, 2] and changes.next_jobs(files, "done", claimed).first() is None


def test_readers():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Helvetica;}}{\colortbl;\red0;}{\info{\title hidden title}}{\*\generator Riched20;}Caf\'e9 heron notes\par Second line with \{braces\} and \u8364?uro and a\tab tab.\par}"
    assert extract.rtf_text(rtf) == "Café heron notes\nSecond line with {braces} and €uro and a\ttab.\n"
    assert extract.rtf_text(rb"{\rtf1\ansi rtf numbat\par}") == "rtf numbat\n"
    assert extract.pdf_pages("\fb\f\fd\f") == [(1, ""), (2, "b"), (4, "d")]
    assert extract.markup_text(b"<p>a&amp;b</p><script>x</p></script><br/>c") == "a&b\n\nc"
    assert extract.missing_tools({"pdf", "text", "image"}, extract.Backend(ocr=lambda b: "")) == ["pdf"]


def test_models_and_tokens():
    from tesserae.functions import models

    urls = {"": "http://127.0.0.1:11434", "0.0.0.0": "http://127.0.0.1:11434", "box:8080": "http://box:8080", "https://far.example/api/": "https://far.example:11434/api", "[::1]:9": "http://[::1]:9", "http://x:port": "http://127.0.0.1:11434"}
    assert {h: models.base_url(h) for h in urls} == urls
    assert models.chosen_model(["mix", "llama3.2:1b"]) == "llama3.2:1b" and models.chosen_model(["mix"]) == "mix" and models.chosen_model([], "own") == "own"
    with pytest.raises(LookupError):
        models.chosen_model([])
    token = models.new_token()
    assert len(token) == 64 and models.same_token(token, token) and not models.same_token("x", token) and not models.same_token("", "")


class Images(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):
        Images.asked.append(self.path)
        if self.path == "/slow.png" and Images.asked.count("/slow.png") == 1:
            time.sleep(1.5)
        body = b"y" * (5000 if self.path == "/big.png" else 10)
        self.send_response(404 if self.path == "/none.png" else 200)
        self.send_header("Content-Type", "text/html" if self.path == "/page" else "image/png")
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *_):
        pass


def test_remote_images():
    from tesserae.sources import remote

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Images)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert remote.fetch(f"{base}/a.png", hedge=1) == b"y" * 10
    started = time.monotonic()
    assert remote.fetch(f"{base}/slow.png", hedge=0.2) == b"y" * 10 and time.monotonic() - started < 1.2 and Images.asked.count("/slow.png") == 2
    for url, most in ((f"{base}/page", 100), (f"{base}/big.png", 100), ("file:///etc/hosts", 100)):
        with pytest.raises(remote.NotAnImage):
            remote.fetch(url, most)
    with pytest.raises(OSError):
        remote.fetch(f"{base}/none.png")
    assert Images.asked.count("/none.png") == 1
    server.shutdown()


def test_recognition_codes_equal_the_column(spark):
    settings = ["", "en-US", " fr-FR , de", "xx-YY", "zh-Hant", "en, en-GB,hi-IN"]
    rows = spark.createDataFrame([(s,) for s in settings], "s string").select("s", T.recognition_languages("s").alias("codes")).collect()
    assert {r.s: r.codes for r in rows} == {s: extract.recognition_codes(s) for s in settings}


def test_tools_are_looked_for_again(monkeypatch):
    extract._tools.clear()
    assert extract.tool("no-such-program-here") is None
    monkeypatch.setattr(extract.shutil, "which", lambda n: f"/bin/{n}")
    assert extract.tool("no-such-program-here") is None
    monkeypatch.setattr(extract, "LOOK_AGAIN", -1.0)
    assert extract.tool("no-such-program-here") == "/bin/no-such-program-here"
