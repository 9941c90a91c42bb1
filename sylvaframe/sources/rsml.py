"""Root models in RSML files: readers of the extended and the standard form, their metadata, and a writer of both.

A file is one model and is read as one text; its tags become rows at once, and all further work is on rows. The writer makes one
text of a model, so a model has to fit into a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvaframe.operators.cut import cut
from sylvaframe.operators.models import first_nodes
from sylvaframe.operators.traits import ROOT

_TAGS = r"(<plant\b[^>]*>|<root\b[^>]*>|</root>|<point\b[^>]*>|<function\b[^>]*>|<sample\b[^>]*/>|<sample\b[^>]*>[^<]*</sample>)"
#: Programs whose files are so dense that every fifth point is kept. (A fixed value.)
DENSE = ("Root System Analyzer",)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """model and value of all files under a path; the model is a partition of the path, else the file's name without its ending."""
    texts = spark.read.text(path, wholetext=True)
    if "model" not in texts.columns:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(\.[^./]*)?$", 1)
        texts = texts.select(name.alias("model"), "value")
    return texts


def attribute(tag: Column | str, name: str) -> Column:
    """An attribute of a tag; null where it is missing."""
    return F.nullif(F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1), F.lit(""))


def metadata(texts: DataFrame) -> DataFrame:
    """model, version, unit, size, software, user, file_key, hours (0 and the observation hours), image and dpi of each file."""
    of = lambda name: F.regexp_extract("value", f"<{name}>([^<]*)</{name}>", 1)
    hours = F.transform(F.filter(F.split(of("observation-hours"), ","), lambda h: F.trim(h) != ""), lambda h: h.cast("double"))
    size = of("size").try_cast("double")
    rows = texts.select(
        "model", of("version").alias("version"), of("unit").alias("unit"), size.alias("size"), of("software").alias("software"), of("user").alias("user"), of("file-key").alias("file_key"),
        F.concat(F.array(F.lit(0.0)), hours).alias("hours"), F.regexp_extract("value", r"<image>\s*<label>([^<]*)</label>", 1).alias("image"),
    )
    return rows.withColumn("dpi", dpi(F.col("unit"), F.col("size")))


def dpi(unit: Column, resolution: Column) -> Column:
    """Pixels an inch from pixels a unit; 0 for an unknown unit."""
    starts = lambda *names: unit.rlike("^(" + "|".join(names) + ")")
    return F.when(starts("cm", "cen"), resolution * 2.54).when(starts("mm", "mill"), resolution / 10 * 2.54).when(starts("m"), resolution * 100 * 2.54).when(starts("IN", "in"), resolution).otherwise(0.0)


def _tags(texts: DataFrame, dense: Sequence[str] = DENSE) -> DataFrame:
    """Tags in order, each with the root that it belongs to: the last one that opened at its depth."""
    # A tag's row must not look into its file's text: that would read the text once for each tag.
    software = F.regexp_extract("value", "<software>([^<]*)</software>", 1).isin(*dense)
    files = texts.select("model", F.struct(software.alias("dense"), F.regexp_extract_all("value", F.lit(_TAGS), F.lit(1)).alias("tags")).alias("f"))
    tags = files.select("model", "f.dense", F.posexplode("f.tags").alias("pos", "tag")).select("model", "pos", "tag", "dense")
    file, opens = Window.partitionBy("model").orderBy("pos"), F.col("tag").rlike(r"^<root\b") & ~F.col("tag").endswith("/>")
    tags = tags.withColumn("depth", F.sum(F.when(opens, 1).when(F.col("tag") == "</root>", -1).otherwise(0)).over(file))
    level = Window.partitionBy("model", "depth").orderBy("pos")
    owner = F.when(opens, F.struct("pos", attribute("tag", "ID").alias("id"), attribute("tag", "label").alias("label")))
    plant = F.when(F.col("tag").startswith("<plant"), attribute("tag", "ID"))
    function = F.when(F.col("tag").startswith("<function"), attribute("tag", "name"))
    return tags.withColumn("root", F.last(owner, ignorenulls=True).over(level)).withColumn("plant", F.last(plant, ignorenulls=True).over(file)).withColumn("function", F.last(function, ignorenulls=True).over(level))


def _points(tags: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("model", "root.pos").orderBy("pos"))
    rows = tags.where(F.col("tag").startswith("<point")).withColumn("seq", number)
    order = F.size(F.split("root.id", "[.]")) - 1
    return rows.select("model", F.col("root.pos").alias("root_pos"), F.col("root.id").alias("root_id"), F.col("root.label").alias("label"), "plant", order.alias("ord"), "seq", "tag", "dense")


def read_extended(texts: DataFrame) -> DataFrame:
    """model, plant, root_id, label, ord, seq, x, y, t, th, diameter, vx and vy of each point; the order is the number of dots in the root's id."""
    value = lambda name, to: attribute("tag", name).try_cast("double").alias(to)
    return _points(_tags(texts)).select(
        "model", "plant", "root_id", "label", "ord", "seq", value("coord_x", "x"), value("coord_y", "y"), value("coord_t", "t"), value("coord_th", "th"), value("diameter", "diameter"), value("vx", "vx"), value("vy", "vy")
    )


def read_standard(texts: DataFrame, dense: Sequence[str] = DENSE) -> DataFrame:
    """model, plant, root_id, label, ord, seq, x, y, diameter, t and th: points with the samples of the same place of the functions diameter, timepoint and hours.

    Of files of programs that write dense polylines (`dense`: their names) every fifth point is kept, from the first on.
    """
    tags = _tags(texts, dense).transform(cut)
    number = F.row_number().over(Window.partitionBy("model", "root.pos", "function").orderBy("pos"))
    text = F.coalesce(attribute("tag", "value"), F.regexp_extract("tag", ">([^<]*)<", 1))
    samples = tags.where(F.col("tag").startswith("<sample")).select("model", F.col("root.pos").alias("root_pos"), number.alias("seq"), "function", text.try_cast("double").alias("v"))
    of = lambda name: F.max(F.when(F.col("function") == name, F.col("v")))
    by_place = samples.groupBy("model", "root_pos", "seq").agg(of("diameter").alias("diameter"), of("timepoint").alias("t"), of("hours").alias("th"))
    rows = _points(tags).where(~F.col("dense") | ((F.col("seq") - 1) % 5 == 0)).join(by_place, ["model", "root_pos", "seq"], "left")
    return rows.select("model", "plant", "root_id", "label", "ord", "seq", attribute("tag", "x").try_cast("double").alias("x"), attribute("tag", "y").try_cast("double").alias("y"), "diameter", "t", "th")


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def root_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """model, root, parent, level, plant and id: `plant.1` for primaries, numbered by the x of their first node; a child's number among its siblings goes behind its parent's id."""
    first = F.row_number().over(Window.partitionBy("model").orderBy("fx", "root"))
    level = first_nodes(nodes).join(roots.where("parent is null"), ROOT).select(*ROOT, "parent", F.lit(1).alias("level"), first.alias("plant"))
    level = level.withColumn("id", F.concat(F.col("plant").cast("string"), F.lit(".1"))).transform(cut)
    sibling = F.row_number().over(Window.partitionBy("model", "parent").orderBy("root"))
    children = roots.where("parent is not null").withColumn("n", sibling)
    found = level
    while not level.isEmpty():
        above = level.select("model", F.col("root").alias("parent"), F.col("level").alias("l"), "plant", F.col("id").alias("above"))
        level = children.join(above, ["model", "parent"]).select(*ROOT, "parent", (F.col("l") + 1).alias("level"), "plant", F.concat("above", F.lit("."), F.col("n").cast("string")).alias("id")).transform(cut)
        found = found.unionByName(level)
    return found


def to_rsml(nodes: DataFrame, roots: DataFrame, hours: list[float], pixel_size: float = 1.0, standard: bool = False, digits: int | None = None) -> DataFrame:
    """model and value: the file's text. nodes: x, y, t, th, diameter and, for the extended form, vx and vy; every order is nested in its parent."""
    number = lambda c: (F.col(c).cast("double") if digits is None else F.round(F.col(c).cast("double"), digits)).cast("string")
    names = {"x": "x", "y": "y"} if standard else {"x": "coord_x", "y": "coord_y", "vx": "vx", "vy": "vy", "diameter": "diameter", "t": "coord_t", "th": "coord_th"}
    point = F.concat(F.lit("<point"), *(F.concat(F.lit(f' {name}="'), number(c), F.lit('"')) for c, name in names.items()), F.lit("/>"))
    functions = {"diameter": "diameter", "t": "timepoint", "th": "hours"} if standard else {}
    samples = [F.concat(F.lit("<sample>"), number(c), F.lit("</sample>")).alias(f"f_{c}") for c in functions]
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda p: p[c]), "")
    lines = nodes.select(*ROOT, "seq", point.alias("point"), *samples).groupBy(*ROOT).agg(joined("point").alias("points"), *(joined(f"f_{c}").alias(f"f_{c}") for c in functions))
    own = [F.concat(F.lit("<geometry><polyline>"), "points", F.lit("</polyline></geometry>"))]
    if functions:
        listed = [F.concat(F.lit(f'<function name="{name}" domain="polyline">'), f"f_{c}", F.lit("</function>")) for c, name in functions.items()]
        own += [F.lit("<functions>"), *listed, F.lit("</functions>")]
    rows = root_ids(nodes, roots).join(lines, ROOT).select(*ROOT, "parent", "level", "plant", "id", F.concat(*own).alias("own")).transform(cut)
    inside = None
    for level in range(rows.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], 0, -1):
        some = rows.where(F.col("level") == level)
        some = some.join(inside, ROOT, "left") if inside is not None else some.withColumn("inside", F.lit(""))
        text = F.concat(F.lit('<root ID="'), "id", F.lit('" label="">'), "own", F.coalesce("inside", F.lit("")), F.lit("</root>"))
        some = some.select(*ROOT, "parent", "plant", "id", text.alias("xml"))
        if level > 1:
            # A place in a list is the number at the end of an id.
            place = F.substring_index("id", ".", -1).cast("int").alias("n")
            joined_children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "xml"))), lambda c: c["xml"]), "")
            inside = some.groupBy("model", F.col("parent").alias("root")).agg(joined_children.alias("inside")).transform(cut)
    if inside is None and rows.isEmpty():
        return rows.select("model", F.lit("").alias("value"))
    plant = F.concat(F.lit('<plant ID="'), F.col("plant").cast("string"), F.lit('" label="">'), "xml", F.lit("</plant>"))
    scene = some.select("model", "plant", plant.alias("xml")).groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plant", "xml"))), lambda p: p["xml"]), "").alias("scene"))
    key = _escaped(F.col("model").cast("string"))
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<rsml><metadata><version>1.4</version><unit>pixel(um)</unit><size>{pixel_size}</size><software>sylvaframe</software><user>Unknown</user><file-key>'), key,
        F.lit(f"</file-key><observation-hours>{','.join(str(float(h)) for h in hours)}</observation-hours><image><label>"), key, F.lit("</label><sha256>Nothing there</sha256></image></metadata><scene>"),
    )
    return scene.select("model", F.concat(head, "scene", F.lit("</scene></rsml>")).alias("value"))


def write_rsml(documents: DataFrame, path: str) -> None:
    """One folder for each model, with its file in it."""
    documents.write.partitionBy("model").text(path, lineSep="\n")
