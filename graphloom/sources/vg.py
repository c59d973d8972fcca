"""Grouped protobuf streams of graph and alignment messages.

A stream is a sequence of groups: a varint count, then for each message a varint length and its bytes; the whole is
usually gzipped. Fields are read by number, unknown ones are skipped.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the messages. (name, kind, repeated); kind: a message's name, or a scalar.
MESSAGES = {
    "Graph": {1: ("node", "Node", True), 2: ("edge", "Edge", True), 3: ("path", "Path", True)},
    "Node": {1: ("sequence", "string", False), 2: ("name", "string", False), 3: ("id", "int", False)},
    "Edge": {1: ("from", "int", False), 2: ("to", "int", False), 3: ("from_start", "bool", False), 4: ("to_end", "bool", False), 5: ("overlap", "int", False)},
    "Path": {1: ("name", "string", False), 2: ("mapping", "Mapping", True), 3: ("is_circular", "bool", False), 4: ("length", "int", False)},
    "Mapping": {1: ("position", "Position", False), 2: ("edit", "Edit", True), 5: ("rank", "int", False)},
    "Position": {1: ("node_id", "int", False), 2: ("offset", "int", False), 4: ("is_reverse", "bool", False), 5: ("name", "string", False)},
    "Edit": {1: ("from_length", "int", False), 2: ("to_length", "int", False), 3: ("sequence", "string", False)},
    "Alignment": {1: ("sequence", "string", False), 2: ("path", "Path", False), 3: ("name", "string", False), 4: ("quality", "bytes", False), 5: ("mapping_quality", "int", False), 6: ("score", "int", False)},
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def decode(data: bytes, message: str) -> dict:
    fields, out, at = MESSAGES[message], {}, 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire == 1:
            raw, at = struct.unpack_from("<q", data, at)[0], at + 8
        elif wire == 5:
            raw, at = struct.unpack_from("<i", data, at)[0], at + 4
        elif wire == 2:
            n, at = _varint(data, at)
            raw, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire} is not supported")
        if number not in fields:
            continue
        name, kind, repeated = fields[number]
        if kind in MESSAGES:
            raw = decode(raw, kind)
        elif kind == "string":
            raw = raw.decode()
        elif kind == "int":
            raw -= (raw >= 1 << 63) << 64
        elif kind == "bool":
            raw = bool(raw)
        if repeated:
            out.setdefault(name, []).append(raw)
        else:
            out[name] = raw
    return out


def _as_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(value: dict, message: str) -> bytes:
    out = bytearray()
    for number, (name, kind, repeated) in MESSAGES[message].items():
        for x in value.get(name, []) if repeated else [value[name]] if value.get(name) not in (None, 0, False, "", b"") else []:
            if kind in ("int", "bool"):
                out += _as_varint(number << 3) + _as_varint(int(x))
            else:
                raw = encode(x, kind) if kind in MESSAGES else x.encode() if kind == "string" else x
                out += _as_varint(number << 3 | 2) + _as_varint(len(raw)) + raw
    return bytes(out)


def messages(data: bytes) -> Iterator[bytes]:
    """The messages of a stream, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        count, at = _varint(data, at)
        for _ in range(count):
            n, at = _varint(data, at)
            yield data[at : at + n]
            at += n


def stream(parts: list[bytes], group: int = 1000) -> bytes:
    """A gzipped stream of messages."""
    out = bytearray()
    for i in range(0, len(parts), group):
        own = parts[i : i + group]
        out += _as_varint(len(own)) + b"".join(_as_varint(len(p)) + p for p in own)
    return gzip.compress(bytes(out), mtime=0)


def read_messages(spark: SparkSession, path: str, message: str) -> DataFrame:
    """json of every message of every file; files are read in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows: list[str] = []
                for m in messages(bytes(data)):
                    rows.append(json.dumps(decode(m, message), default=lambda b: b.hex()))
                    if len(rows) == 1000:
                        yield pd.DataFrame({"json": rows})
                        rows = []
                yield pd.DataFrame({"json": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "json string")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node_id, seq), edges and path steps of a graph in chunks; repeated nodes and edges count once."""
    position = "struct<node_id:long,offset:long,is_reverse:boolean>"
    schema = (
        "node array<struct<id:long,sequence:string>>, edge array<struct<`from`:long,`to`:long,from_start:boolean,to_end:boolean,overlap:int>>,"
        f" path array<struct<name:string,mapping:array<struct<position:{position},rank:long>>>>"
    )
    g = read_messages(spark, path, "Graph").select(F.from_json("json", schema).alias("g")).select("g.*")
    nodes = g.select(F.explode("node").alias("n")).select(F.col("n.id").alias("node_id"), F.upper("n.sequence").alias("seq")).distinct()
    e = g.select(F.explode("edge").alias("e"))
    no = F.lit(False)
    edges = e.select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.from_start", no).alias("from_start"), F.coalesce("e.to_end", no).alias("to_end"), F.coalesce("e.overlap", F.lit(0)).alias("overlap")).distinct()
    m = g.select(F.explode("path").alias("p")).select(F.col("p.name").alias("path_name"), F.explode("p.mapping").alias("m"))
    steps = m.select("path_name", (F.col("m.rank") - 1).cast("int").alias("pos"), F.col("m.position.node_id").alias("node_id"), F.coalesce("m.position.is_reverse", no).alias("is_reverse"))
    return nodes, edges, steps


def path_alignments(paths: DataFrame) -> DataFrame:
    """content: a gzipped stream of one alignment for each (path_id, text, mapping) row, a stream for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for pdf in batches:
            for name, text, mapping in zip(pdf["path_id"], pdf["text"], pdf["mapping"], strict=True):
                steps = [{"position": {"node_id": int(m["node_id"]), "offset": int(m["offset"])}, "edit": [{k: e[k] for k in ("from_length", "to_length", "sequence")} for e in m["edit"]], "rank": int(m["rank"])} for m in mapping]
                parts.append(encode({"name": str(name), "sequence": text, "path": {"name": str(name), "mapping": steps}}, "Alignment"))
        if parts:
            yield pd.DataFrame({"content": [stream(parts)]})

    return paths.select("path_id", "text", "mapping").mapInPandas(run, "content binary")


def graph_chunks(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """content: gzipped streams of one graph message for every `most` ranks; an edge is in the chunk of its source."""
    n = nodes.select(F.floor(F.col("rank") / most).alias("chunk"), "node_id", "seq", F.lit(None).cast("long").alias("dst"))
    e = edges.join(nodes.select(F.col("node_id").alias("src"), "rank"), "src").select(F.floor(F.col("rank") / most).alias("chunk"), F.col("src").alias("node_id"), F.lit(None).cast("string").alias("seq"), "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["dst"].isna()], pdf[pdf["dst"].notna()]
        graph = {
            "node": [{"id": int(i), "sequence": s} for i, s in zip(own["node_id"], own["seq"], strict=True)],
            "edge": [{"from": int(a), "to": int(b)} for a, b in zip(links["node_id"], links["dst"], strict=True)],
        }
        return pd.DataFrame({"content": [stream([encode(graph, "Graph")])]})

    return n.union(e).groupBy("chunk").applyInPandas(run, "content binary")


def write_streams(df: DataFrame, path: str) -> None:
    """The streams (column content) as one Parquet table of binaries; gzip streams may be put one after the other."""
    df.select("content").write.mode("overwrite").parquet(path)
