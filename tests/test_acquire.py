"""Downloads from a local server that breaks off, and archives."""

import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import SimpleNamespace

import pytest

from placelink.sources import acquire

CONTENT = bytes(range(256)) * 4_000


@pytest.fixture
def server():
    seen = []
    told = SimpleNamespace(content=CONTENT, etag='"one"', ranges=True, breaks=0, seen=seen, status=200)

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            seen.append("HEAD")
            self.send_response(200)
            self.send_header("Content-Length", str(len(told.content)))
            self.end_headers()

        def do_GET(self):
            asked = self.headers.get("Range")
            seen.append(asked or "GET")
            if told.status != 200:
                self.send_error(told.status)
                return
            begin = 0
            if asked and told.ranges and self.headers.get("If-Range") == told.etag:
                begin = int(asked.removeprefix("bytes=").rstrip("-"))
            self.send_response(206 if begin else 200)
            if begin:
                self.send_header("Content-Range", f"bytes {begin}-{len(told.content) - 1}/{len(told.content)}")
            if told.etag:
                self.send_header("ETag", told.etag)
            self.send_header("Content-Length", str(len(told.content) - begin))
            self.end_headers()
            body = told.content[begin:]
            if told.breaks:
                told.breaks -= 1
                body = body[: len(body) // 2]
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    told.url = f"http://127.0.0.1:{held.server_port}/data/places.txt"
    yield told
    held.shutdown()


def test_an_unchanged_file_is_not_fetched_again(server, tmp_path):
    target = tmp_path / "cache" / "places.txt"
    for _ in range(2):
        assert acquire.download(server.url, target).read_bytes() == CONTENT
    assert server.seen == ["GET", "HEAD"]
    server.content = b"new"
    assert acquire.download(server.url, target).read_bytes() == b"new" and server.seen[2:] == ["HEAD", "GET"]
    assert [p.name for p in target.parent.iterdir()] == ["places.txt"]


def test_a_broken_transfer_goes_on_where_it_stopped(server, tmp_path):
    server.breaks = 2
    assert acquire.download(server.url, tmp_path / "places.txt").read_bytes() == CONTENT
    half = len(CONTENT) // 2
    assert server.seen == ["GET", f"bytes={half}-", f"bytes={half + half // 2}-"]


@pytest.mark.parametrize("change", [{"ranges": False}, {"etag": None}])
def test_without_ranges_it_begins_anew(server, tmp_path, change):
    server.breaks = 1
    server.__dict__.update(change)
    assert acquire.download(server.url, tmp_path / "places.txt").read_bytes() == CONTENT


def test_a_changed_file_is_not_mixed_with_the_old_one(server, tmp_path):
    server.breaks = 10
    with pytest.raises((OSError, acquire.http.client.HTTPException)):
        acquire.download(server.url, tmp_path / "places.txt")
    assert not (tmp_path / "places.txt").exists() and (tmp_path / "places.txt.part").exists()
    server.breaks, server.etag, server.content = 0, '"two"', b"z" * 5_000_000
    assert acquire.download(server.url, tmp_path / "places.txt").read_bytes() == server.content


def test_errors_of_the_request_are_told_at_once(server, tmp_path):
    server.status = 404
    with pytest.raises(acquire.urllib.error.HTTPError):
        acquire.download(server.url, tmp_path / "places.txt")
    assert server.seen == ["GET"]


def test_a_source_from_a_server_out_of_an_archive(server, tmp_path):
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as held:
        held.writestr("inner/places.txt", "1\tOne")
    server.content = archive.read_bytes()
    source = SimpleNamespace(name="s", url=server.url.replace("places.txt", "all.zip"), path=None, file="places.txt")
    found = acquire.resolve(source, tmp_path, tmp_path / "cache")
    assert found.read_text() == "1\tOne" and found == acquire.resolve(source, tmp_path, tmp_path / "cache")
    with zipfile.ZipFile(archive, "w") as held:
        held.writestr("../out.txt", "no")
    with pytest.raises(ValueError):
        acquire.unpack(archive, tmp_path / "other", "out.txt")
