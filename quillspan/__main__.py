"""python -m quillspan TEXTS [options]: from text files to a graph."""

from __future__ import annotations

import argparse
import logging

from .backends import ChatBackend, RulesBackend
from .plans.pipeline import run_pipeline
from .session import build_session
from .sources.documents import draw_html, read_text_documents, write_graph


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspan", description="Reads text files, extracts and resolves entities, and writes the graph of their relations and traits.")
    p.add_argument("texts", help="a file, a folder or a pattern")
    p.add_argument("--out", default="graph", help="where tables of nodes, edges and errors go")
    p.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "import"))
    p.add_argument("--html", help="also a page that draws a small graph")
    p.add_argument("--backend", default="rules", choices=("rules", "chat"))
    p.add_argument("--encoding", default="UTF-8")
    p.add_argument("--master", help="as spark-submit's, if it does not say")
    p.add_argument("--strict", action="store_true", help="stop at the first row without an accepted reply")
    told = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = build_session(told.master)
    out = run_pipeline(read_text_documents(spark, told.texts, told.encoding), ChatBackend() if told.backend == "chat" else RulesBackend(), strict=told.strict)
    write_graph(out["nodes"], out["edges"], told.out, told.format)
    out["errors"].write.mode("overwrite").format("json").save(f"{told.out}/errors")
    if told.html:
        draw_html(out["nodes"], out["edges"], told.html)


if __name__ == "__main__":
    main()
