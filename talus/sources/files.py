"""Point-cloud files: PLY and LAS through the data source of ``points``, XYZ text and tables by Spark's readers; writers."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.model import COLUMNS, Parameters
from talus.session import cut, drop
from talus.sources import points

def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """First three columns of white-space separated text; comments and rows with NaN are left out."""
    t = spark.read.text(path).select(
        F.split(F.trim("value"), r"\s+").alias("v"),
        F.monotonically_increasing_id().alias("pid"),
    ).where("size(v) >= 3 AND NOT startswith(v[0], '#')")
    return t.selectExpr("pid", *[f"CAST(v[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz")]).where(" AND ".join(f"NOT isnan({c})" for c in "xyz"))


def read_cloud(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = points.SPLIT) -> DataFrame:
    """Reader by suffix: .ply, .las, .xyz or .txt; .laz has no codec here. ``columns``: some of those of points.SCHEMA; only these are built. ``split``:
    bytes of a file that one task reads.

    LAS colours are brought to bytes where a file has larger ones, which one pass over the colours finds out beforehand, if they are asked for."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".xyz", ".txt"):
        return read_xyz(spark, path)
    if suffix == ".laz":
        raise RuntimeError("LAZ: compressed points need a codec that isn't installed")
    if suffix not in (".ply", ".las"):
        raise ValueError(f"unknown point-cloud format: {suffix}")
    paths = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # one name a file, which the planner has listed anyway
    spark.dataSource.register(points.PointFiles)
    columns = columns or [f.split()[0] for f in points.SCHEMA.split(", ")]
    kinds = dict(f.split(" ", 1) for f in points.SCHEMA.split(", "))
    load = lambda own: spark.read.format("talus_points").schema(", ".join(f"{c} {kinds[c]}" for c in own)).options(paths="\n".join(paths), kind=suffix[1:], split=split).load()
    rgb = [c for c in columns if c in _RGB]
    if suffix == ".ply" or not rgb:
        return load(columns)
    rows = load(list(dict.fromkeys([*columns, "path", "extra"])))
    largest = load(["path", "extra"]).groupBy("path").agg(F.max(F.greatest(*[F.col("extra")[f"{c}_16"] for c in _RGB])).alias("most_"))
    rows = rows.join(F.broadcast(largest), "path")  # one row a file
    byte = lambda c: f"CAST(CASE WHEN most_ > 255 THEN floor(extra['{c}_16'] / 256) ELSE extra['{c}_16'] END AS SMALLINT) AS {c}"
    return rows.selectExpr(*[byte(c) if c in _RGB else c for c in columns])


_RGB = ("red", "green", "blue")


def ply_header(n: int | str, colours: bool, text: bool) -> bytes:
    names = "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in _RGB if colours)
    return f"ply\nformat {'ascii' if text else 'binary_little_endian'} 1.0\nelement vertex {n}\n{names}end_header\n".encode()


def ply_body(points: np.ndarray, colours: np.ndarray | None = None, text: bool = True) -> bytes:
    """Doubles x, y, z and, if given, colours clipped to 0 to 255."""
    colours = np.clip(colours, 0, 255).astype(np.uint8) if colours is not None else None
    if text:
        return "".join(" ".join([*(repr(float(v)) for v in p), *(map(str, colours[i]) if colours is not None else ())]) + "\n" for i, p in enumerate(points)).encode()
    rows = np.zeros(len(points), [(c, "<f8") for c in "xyz"] + [(c, "u1") for c in _RGB if colours is not None])
    for i, c in enumerate("xyz"):
        rows[c] = points[:, i]
    for i, c in enumerate(_RGB if colours is not None else ()):
        rows[c] = colours[:, i]
    return rows.tobytes()


def ply_bytes(points: np.ndarray, colours: np.ndarray | None = None, text: bool = True) -> bytes:
    return ply_header(len(points), colours is not None, text) + ply_body(points, colours, text)


def _own(path: str) -> str:
    """A name beside the path that no other attempt has."""
    return f"{path}.{uuid.uuid4().hex}.tmp"


def _bodies(batches, text: bool, coloured: bool):
    for pdf in batches:
        yield len(pdf), ply_body(pdf[["x", "y", "z"]].to_numpy(float), pdf[list(_RGB)].fillna(0).to_numpy() if coloured else None, text)


def write_ply(cloud: DataFrame, path: str, text: bool = False, parts: bool = False) -> DataFrame:
    """cloud (x, y, z and, if there, red, green, blue) as PLY in a folder that the executors share; returns (path, n).

    All tasks write one file: rows become blocks of bytes, sums of the partitions' sizes give each block its place, and each task writes its own (points.BlockSink).
    With ``parts`` each partition writes a file of its own, named by its number (the tool of the next step must then take a folder)."""
    coloured = set(_RGB) <= set(cloud.columns)
    rows = cloud.select("x", "y", "z", *(_RGB if coloured else ()))

    def own_file(batches):
        from pyspark import TaskContext

        goal, n = f"{os.path.splitext(path)[0]}.{TaskContext.get().partitionId():05d}.ply", 0
        own = _own(goal)
        with open(own, "wb") as f:
            f.write(ply_header("0" * 20, coloured, text))  # the number is known at the end
            for m, body in _bodies(batches, text, coloured):
                n += m
                f.write(body)
            f.seek(0)
            f.write(ply_header(f"{n:020d}", coloured, text))
        os.replace(own, goal)  # a task that runs again replaces what it wrote
        yield pd.DataFrame({"path": [goal], "n": [n]})

    def blocks(batches):
        from pyspark import TaskContext

        for i, (n, body) in enumerate(_bodies(batches, text, coloured)):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "i": [i], "n": [n], "block": [body]})

    if parts:
        return rows.mapInPandas(own_file, "path string, n long")
    spark = cloud.sparkSession
    made = cut(rows.mapInPandas(blocks, "part int, i int, n long, block binary"))
    sizes = made.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.octet_length("block")).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    head = ply_header(total[0], coloured, text)
    before = sizes.selectExpr("part", f"sum(size) OVER (ORDER BY part) - size + {len(head)} AS before")  # one row a partition
    placed = made.join(F.broadcast(before), "part").selectExpr("before + sum(octet_length(block)) OVER (PARTITION BY part ORDER BY i) - octet_length(block) AS at", "block")
    placed = placed.unionByName(spark.createDataFrame([(0, bytearray(head))], "at long, block binary"))
    spark.dataSource.register(points.BlockSink)
    placed.write.format("talus_blocks").options(path=path, size=len(head) + total[1], run=uuid.uuid4().hex).mode("append").save()
    drop(made)
    return spark.createDataFrame([(path, total[0])], "path string, n long")


def write_ply_groups(cloud: DataFrame, folder: str, name: str, label: str = "label", text: bool = True) -> DataFrame:
    """One file ``{name}_grain_{label}.ply`` for each label (null: no grain), by the executors, into a folder they share; returns (label, path, n).

    Rows come sorted by label and are streamed, so that a task holds a batch and not a grain."""
    coloured = set(_RGB) <= set(cloud.columns)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        now, f, n, own = None, None, 0, ""

        def closed():
            f.seek(0)
            f.write(ply_header(f"{n:020d}", coloured, text))
            f.close()
            os.replace(own, goal(now))
            return {"label": now, "path": goal(now), "n": n}

        goal = lambda v: os.path.join(folder, f"{name}_grain_{v}.ply")
        done = []
        for pdf in batches:
            for v, part in pdf.groupby("label", sort=False):
                if v != now:
                    if f:
                        done.append(closed())
                    now, n, own = int(v), 0, _own(goal(int(v)))
                    f = open(own, "wb")  # noqa: SIM115
                    f.write(ply_header("0" * 20, coloured, text))
                n += len(part)
                f.write(ply_body(part[["x", "y", "z"]].to_numpy(float), part[list(_RGB)].to_numpy() if coloured else None, text))
        if f:
            done.append(closed())
        yield pd.DataFrame(done, columns=["label", "path", "n"])

    rows = cloud.where(f"{label} IS NOT NULL").select(F.col(label).cast("long").alias("label"), "x", "y", "z", *(_RGB if coloured else ()))
    return rows.repartition("label").sortWithinPartitions("label").mapInPandas(run, "label long, path string, n long")


def parameter_rows(table: DataFrame, order: str) -> DataFrame:
    """Typed parameters of each Name, of its first row by ``order``: blank or missing values take the default, a bad number raises."""
    have = {c.lower(): c for c in table.columns}
    first = table.groupBy(F.trim("Name").alias("name_")).agg(F.min_by(F.struct("*"), order).alias("p"))
    out = ["name_ AS name"]
    for f in fields(Parameters):
        if f.name == "name":
            continue
        column = have.get(COLUMNS.get(f.name, f.name).lower())
        text = f"nullif(trim(CAST(p.`{column}` AS STRING)), '')" if column else "CAST(NULL AS STRING)"
        kind = type(f.default)
        typed = f"lower({text}) IN ('1', 'true', 'yes', 'y')" if kind is bool else f"CAST(CAST({text} AS DOUBLE) AS INT)" if kind is int else f"CAST({text} AS DOUBLE)" if kind is float else text
        default = f"'{f.default}'" if kind is str else f"{f.default!r}D" if kind is float else str(f.default).lower()
        out.append(f"coalesce({typed}, {default}) AS {f.name}")
    return first.selectExpr(*out)


def read_parameters(spark: SparkSession, csv: str, name: str) -> Parameters:
    """The parameters of the first row of a parameter CSV whose Name is the file's; the defaults if there is none."""
    t = spark.read.option("header", True).option("encoding", "UTF-8").csv(csv)
    t = t.toDF(*[c.lstrip("\ufeff").strip() for c in t.columns]).where(F.trim("Name") == name).withColumn("order_", F.monotonically_increasing_id())
    rows = parameter_rows(t, "order_").collect()  # one
    return Parameters(**rows[0].asDict()) if rows else Parameters()


def run_folders(root: str, name: str) -> dict[str, str]:
    """The first number free under Grain, Figure, Excel and Cloud alike; makes the folders."""
    for n in range(1, 10_000):
        paths = {k: os.path.join(root, k, f"{name}_n{n}") for k in ("Grain", "Figure", "Excel", "Cloud")}
        if not any(map(os.path.exists, paths.values())):
            for p in paths.values():
                os.makedirs(p)
            return paths | {"index": str(n)}
    raise RuntimeError("no free run number")


def write_granulo(table: DataFrame, path: str) -> None:
    """Headerless CSV with eight significant digits, and beside it an XLSX with a header. A row a grain: the report is small by its nature."""
    pdf = table.toPandas()
    pdf.to_csv(path, header=False, index=False, float_format="%.8g")
    write_xlsx(os.path.splitext(path)[0] + ".xlsx", list(pdf.columns), pdf.itertuples(index=False))


def write_xlsx(path: str, header: list[str], rows) -> None:
    """A one-sheet workbook of numbers and strings."""
    import zipfile
    from xml.sax.saxutils import escape

    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v!r}</v></c>" if v == v and v is not None else "<c/>"
    plain = lambda v: v if isinstance(v, str) else v.item() if hasattr(v, "item") else v
    sheet = "".join(f"<row>{''.join(cell(plain(v)) for v in r)}</row>" for r in ([*header], *rows))
    ns, office = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="{office}-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns.replace("schemas.openxmlformats.org", "schemas.openxmlformats.org/officeDocument/2006")}/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')


def safe_name(path: str) -> str:
    return re.sub(r"\.[^.]+$", "", os.path.basename(path))
