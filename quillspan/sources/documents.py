"""Sources of documents and sinks of graphs."""

from __future__ import annotations

import json
from html import escape
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(doc_id, text): a row for each file; the id is the file's name without its extension, line ends become newlines.

    `encoding` is one that the JVM decodes: UTF-8, UTF-16, ISO-8859-1, windows-1252 and so on."""
    rows = spark.read.format("binaryFile").load(path)  # `path` names files as they are; metadata columns would escape them
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.select(name.alias("doc_id"), F.regexp_replace(F.decode("content", encoding), "\r\n?", "\n").alias("text"))


def read_table_documents(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of a Parquet table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))


#: How bulk import names the columns of nodes and edges.
IMPORT_NAMES = {
    "nodes": {"id": "id:ID", "group": ":LABEL", "label": "label", "title": "title"},
    "edges": {"src": ":START_ID", "dst": ":END_ID", "kind": ":TYPE", "label": "label", "title": "title", "color": "color", "trait_label": "trait_label"},
}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The scalable sink: nodes and edges as tables under `path`, in Parquet, JSON or CSV, or as "import", CSV with the headers of a property graph's bulk import."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        if fmt == "import":
            df = df.select(*[F.col(c).alias(told) for c, told in IMPORT_NAMES[name].items() if c in df.columns])
        kind = "csv" if fmt == "import" else fmt
        df.write.mode("overwrite").format(kind).options(**({"header": "true", "escape": '"'} if kind == "csv" else {})).save(f"{path}/{name}")


def _small(nodes: DataFrame, edges: DataFrame, most: int) -> list[list[dict]]:
    """The rows of a graph that the driver may hold."""
    out = []
    for name, df in (("nodes", nodes), ("edges", edges)):
        out.append([r.asDict() for r in df.limit(most + 1).collect()])
        if len(out[-1]) > most:
            raise ValueError(f"more than {most} {name}: write_graph() is the sink for large graphs")
    return out


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, most: int = 5000) -> str:
    """Writes a small graph as GEXF and returns its path; a driver-side sink as draw_html()."""
    root = ElementTree.Element("gexf", xmlns="http://gexf.net/1.3", version="1.3")
    graph = ElementTree.SubElement(root, "graph", defaultedgetype="directed")
    kinds = (("node", ("group", "title")), ("edge", ("kind", "title", "color")))
    for (kind, fields), rows in zip(kinds, _small(nodes, edges, most), strict=True):
        names = ElementTree.SubElement(graph, "attributes", {"class": kind})
        for f in fields:
            ElementTree.SubElement(names, "attribute", id=f, title=f, type="string")
        items = ElementTree.SubElement(graph, f"{kind}s")
        for i, r in enumerate(rows):
            ends = {"id": r["id"]} if kind == "node" else {"id": str(i), "source": r["src"], "target": r["dst"]}
            item = ElementTree.SubElement(items, kind, ends | {"label": r.get("label") or ""})
            values = ElementTree.SubElement(item, "attvalues")
            for f in fields:
                if r.get(f) is not None:
                    ElementTree.SubElement(values, "attvalue", {"for": f, "value": r[f]})
    ElementTree.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
    return path


#: Page geometry and the physics of the drawing.
PAGE = {"height": 800, "gravity": -2000, "central": 0.2, "spring_length": 150, "spring_strength": 0.01}

_SCRIPT = """
const P=%s,N=%s,E=%s,c=document.querySelector('canvas'),g=c.getContext('2d');c.width=innerWidth;c.height=P.height;
const at=new Map(N.map((n,i)=>[n.id,Object.assign(n,{x:c.width/2+200*Math.cos(i),y:P.height/2+200*Math.sin(i),u:0,v:0})]));
const L=E.filter(e=>at.has(e.src)&&at.has(e.dst));
function step(){for(const n of N){n.u=(c.width/2-n.x)*P.central/100;n.v=(P.height/2-n.y)*P.central/100;
for(const m of N)if(m!==n){const x=n.x-m.x,y=n.y-m.y,d=Math.max(x*x+y*y,25);n.u-=P.gravity*x/d/50;n.v-=P.gravity*y/d/50}}
for(const e of L){const a=at.get(e.src),b=at.get(e.dst),x=b.x-a.x,y=b.y-a.y,d=Math.hypot(x,y)||1,f=(d-P.spring_length)*P.spring_strength;
a.u+=f*x/d;a.v+=f*y/d;b.u-=f*x/d;b.v-=f*y/d}
for(const n of N){n.x+=n.u;n.y+=n.v}g.clearRect(0,0,c.width,c.height);g.font='12px sans-serif';
for(const e of L){const a=at.get(e.src),b=at.get(e.dst),w=Math.atan2(b.y-a.y,b.x-a.x);g.strokeStyle=g.fillStyle=e.color;g.beginPath();g.moveTo(a.x,a.y);g.lineTo(b.x,b.y);
g.lineTo(b.x-8*Math.cos(w-.4),b.y-8*Math.sin(w-.4));g.stroke();g.fillText(e.label,(a.x+b.x)/2,(a.y+b.y)/2)}
for(const n of N){g.fillStyle='#223';g.beginPath();g.arc(n.x,n.y,6,0,7);g.fill();g.fillText(n.label,n.x+8,n.y)}requestAnimationFrame(step)}step()
"""


def draw_html(nodes: DataFrame, edges: DataFrame, out_html: str = "kg_graph.html", most: int = 5000) -> str:
    """Writes a page that draws the graph, with nothing to load, and returns its path.

    This is a driver-side sink for small graphs: with more than `most` nodes or edges it raises; use write_graph() then.
    """
    drawn = [json.dumps(rows).replace("<", "\\u003c") for rows in _small(nodes, edges, most)]
    page = f"<!doctype html><meta charset=utf-8><title>{escape(out_html)}</title><style>body{{margin:0}}canvas{{width:100%;height:{PAGE['height']}px}}</style><canvas></canvas><script>{_SCRIPT % (json.dumps(PAGE), *drawn)}</script>"
    with open(out_html, "w", encoding="utf-8") as f:
        f.write(page)
    return out_html
