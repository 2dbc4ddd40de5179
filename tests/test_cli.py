import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from gapgraph.__main__ import main
from gapgraph.config import Settings
from gapgraph.operators.completion import HttpClient, OfflineClient, attempt, client_for
from gapgraph.service import handle
from gapgraph.streaming.incremental import current_graph, stream_claims, stream_papers

PAD = " This sentence is here to make the paragraph long enough to be kept by the splitter."
TEXTS = {"a.txt": f"Smoke causes lung inflammation through oxidative stress.{PAD}\n\nSmoke triggers cough.{PAD}", "b.txt": f"Lung inflammation leads to fibrosis.{PAD}"}


@pytest.fixture(autouse=True)
def offline(monkeypatch):
    monkeypatch.setenv("GAPGRAPH_PROVIDER", "offline")


@pytest.fixture
def papers(tmp_path):
    folder = tmp_path / "papers"
    folder.mkdir()
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    return folder


def test_commands(spark, papers, tmp_path, capsys):
    graph, full = str(tmp_path / "g"), str(tmp_path / "h")
    assert main(["analyze", str(papers), "-o", graph], spark) == 0
    assert "MISSING_CAUSE" in capsys.readouterr().out
    assert main(["gaps", graph, "--top", "2"], spark) == 0
    assert "smoke" in capsys.readouterr().out
    assert main(["hypothesize", graph, "--max", "2", "-o", full], spark) == 0
    assert main(["show", full, "-o", str(tmp_path / "x.html")], spark) == 0
    page = (tmp_path / "x.html").read_text()
    assert "fibrosis" in page and "#c0392b" in page
    assert main(["analyze", *(str(p) for p in sorted(papers.iterdir())), "--min-confidence", "0.99", "-o", str(tmp_path / "e")], spark) == 0
    assert main(["hypothesize", str(tmp_path / "e")], spark) == 1
    assert main(["analyze", str(tmp_path / "none.txt")], spark) == 1
    assert main(["providers"]) == 0
    assert "* offline: cue-rules" in capsys.readouterr().out


def test_requests(spark):
    client, settings = OfflineClient(), Settings()
    assert handle(spark, client, settings, "GET", "/health", None)[0] == 200
    status, graph = handle(spark, client, settings, "POST", "/analyze", {"texts": list(TEXTS.values())})
    assert status == 200 and len(graph["edges"]) == 3 and graph["papers_analyzed"] == 2
    assert graph["claims"][0]["source_paper"] == "paper_1"
    status, full = handle(spark, client, settings, "POST", "/hypothesize", {"graph": graph, "max_hypotheses": 2})
    assert status == 200 and len(full["hypotheses"]) == 2
    assert handle(spark, client, settings, "POST", "/hypothesize", {"graph": {**graph, "gaps": []}})[0] == 422
    assert handle(spark, client, settings, "POST", "/analyze", {"texts": ["x"], "paper_names": []})[0] == 422
    assert handle(spark, client, settings, "GET", "/nope", None)[0] == 404
    json.dumps(full)


def test_stream(spark, papers, tmp_path):
    claims, checkpoint = str(tmp_path / "claims"), str(tmp_path / "cp")

    def step():
        stream_claims(stream_papers(spark, str(papers)), OfflineClient(), claims, checkpoint).awaitTermination()
        return current_graph(spark, claims).edges.count()

    assert step() == 3
    (papers / "c.txt").write_text(f"Fibrosis results in breathlessness.{PAD}")
    assert step() == 4


class Down(OfflineClient):
    def complete(self, prompt, system, temperature, max_tokens):
        raise OSError("nobody there")


def test_a_provider_that_is_down(spark, papers, capsys, monkeypatch):
    monkeypatch.setenv("GAPGRAPH_MAX_RETRIES", "1")
    assert main(["analyze", str(papers)], spark, Down()) == 1 and "nobody there" in capsys.readouterr().err
    assert handle(spark, Down(), Settings(max_retries=1), "POST", "/analyze", {"texts": list(TEXTS.values())})[0] == 502


def test_one_json_file(spark, papers, tmp_path):
    graph = tmp_path / "graph.json"
    assert main(["analyze", str(papers), "-o", str(graph)], spark) == 0
    assert len(json.loads(graph.read_text())["edges"]) == 3
    assert main(["hypothesize", str(graph), "--max", "1"], spark) == 0


@pytest.mark.parametrize("form", ["chat", "messages", "ollama"])
def test_http_client(form):
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = {"chat": {"choices": [{"message": {"content": " hi "}}]}, "messages": {"content": [{"type": "text", "text": " hi "}]}, "ollama": {"message": {"content": " hi "}}}[form]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient("ollama/m", f"http://127.0.0.1:{server.server_port}/", form, "k")
    assert attempt(client, "ask", "be brief", 0.2, 50, 1) == "hi"
    server.shutdown()
    path, headers, body = seen[0]
    assert body["model"] == "m" and body["messages"][-1] == {"role": "user", "content": "ask"}
    assert {"chat": "/chat/completions", "messages": "/messages", "ollama": "/api/chat"}[form] == path
    sent = {k.lower(): v for k, v in headers.items()}
    assert sent.get("x-api-key" if form == "messages" else "authorization") == ("k" if form == "messages" else "Bearer k")


def test_clients_of_settings(tmp_path):
    made = client_for(Settings(provider="groq", model="m", api_key="s"))
    assert (made.model, made.base, made.form, made.key) == ("m", "https://api.groq.com/openai/v1", "chat", "s")
    assert isinstance(client_for(Settings(provider="offline")), OfflineClient)
    (tmp_path / ".env").write_text("# set\nGAPGRAPH_MODEL='mine'\nexport GAPGRAPH_MAX_HYPOTHESES=3\n")
    assert Settings.from_env(dotenv=str(tmp_path / ".env")).model == "mine" and Settings.from_env(dotenv=str(tmp_path / ".env")).max_hypotheses == 3
