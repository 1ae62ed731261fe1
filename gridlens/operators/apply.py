"""Items read from a grid by its plan: long form first (item, field, value), then folded to one row an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions import scalars, vocab
from gridlens.functions.address import address
from gridlens.operators import naming
from gridlens.operators.read import look, look_rows
from gridlens.session import stored
from gridlens.sources.grids import SHEET

INT_FIELDS = ["quantity"]


def name_map(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """(raw, canonical): the vocabulary as a dimension; as many rows as it has names."""
    return spark.createDataFrame(list((names or vocab.NAME_MAP).items()), "raw string, canonical string")


def named(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `canonical` to labels (raw): the mapped name or the label itself; those mapped to ignore go."""
    mapped = labels.join(F.broadcast(names.withColumn("_key", F.lower("raw")).drop("raw")), F.lower(F.trim("raw")) == F.col("_key"), "left").drop("_key")
    return mapped.withColumn("canonical", F.coalesce("canonical", "raw")).where("canonical <> 'ignore'")


def header_labels(cells: DataFrame, roles: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(c, row, raw): the first text of each column in the header rows, without columns claimed by bands."""
    text = cells.where((F.col("dtype") == "str") & (F.trim("sval") != ""))
    # Header rows are few: they are held, and the texts of a sheet are not sorted to meet them.
    heads = text.join(roles.where("role = 'header'").select(*SHEET, "r").hint("shuffle_hash"), [*SHEET, "r"]).groupBy(*SHEET, "c").agg(F.min_by(F.trim("sval"), "r").alias("raw"), F.min("r").alias("row"))
    return heads.join(claimed, [*SHEET, "c"], "left_anti") if claimed is not None else heads


def title_rows(cells: DataFrame, roles: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(extra_row) of sheets whose header rows label under half of the columns that their data rows fill: the row below
    the last header row, which then holds the labels."""
    data = cells.join(roles.where("role in ('anchor', 'child')").select(*SHEET, "r"), [*SHEET, "r"], "left_semi")
    filled = data.join(claimed, [*SHEET, "c"], "left_anti") if claimed is not None else data
    populated = filled.groupBy(*SHEET).agg(F.count_distinct("c").alias("populated"))
    labels = header_labels(cells, roles, claimed).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("labels"))
    last = roles.where("role = 'header'").groupBy(*SHEET).agg((F.max("r") + 1).alias("extra_row"))
    both = last.join(populated, SHEET).join(labels, SHEET, "left").withColumn("labels", F.coalesce("labels", F.lit(0)))
    return both.where(F.col("labels") * 2 < F.col("populated"))


def with_title_rows(roles: DataFrame, extra: DataFrame) -> DataFrame:
    """Roles in which those rows, and the children under them, are header rows."""
    joined = roles.join(extra.select(*SHEET, "extra_row"), SHEET, "left")
    title = (F.col("r") == F.col("extra_row")) & F.col("role").isin("anchor", "child", "blank")
    below = (F.col("role") == "child") & (F.col("anchor_idx") == F.col("extra_row"))
    changed = F.coalesce(title | below, F.lit(False))
    cleared = {c: F.when(~changed, F.col(c)) for c in ("anchor_idx", "group_id") if c in roles.columns}
    return joined.withColumn("_changed", changed).withColumns({"role": F.when(changed, "header").otherwise(F.col("role")), **cleared}).drop("_changed", "extra_row")


def routed(values: DataFrame) -> DataFrame:
    """Adds is_field, as_text, as_int, as_date and confidence to values (canonical, dtype, sval, nval, dval, source).

    A value its field cannot take goes to the metadata under the same name. A confidence that came with the name wins.
    """
    name = F.col("canonical")
    kinds = F.col("dtype"), F.col("sval"), F.col("nval")
    whole = F.when(name.isin(*INT_FIELDS), scalars.coerce_int(*kinds))
    day = F.when(name == "delivery_date", F.when(F.col("dtype") == "date", F.to_date("dval")).when(F.col("dtype") == "str", scalars.flexible_date(F.col("sval"))))
    fits = F.when(name.isin(*INT_FIELDS), whole.isNotNull()).when(name == "delivery_date", day.isNotNull()).otherwise(F.lit(True))
    found = values.withColumns({"is_field": name.isin(vocab.ITEM_FIELDS) & fits, "as_text": scalars.coerce_text(*kinds), "as_int": whole, "as_date": day})
    sources = F.create_map(*[F.lit(x) for pair in vocab.CONFIDENCE.items() for x in pair])
    rule = F.when(F.col("is_field"), F.coalesce(F.try_element_at(sources, F.col("source")), F.lit(0.5))).otherwise(vocab.CONFIDENCE["metadata"])
    return found.withColumn("confidence", F.coalesce("name_confidence", rule) if "name_confidence" in values.columns else rule)


_PART = ["ord", "canonical", "is_field", "as_text", "as_int", "as_date", "sval", "dtype", "confidence", "addr"]


def parts_of(values: DataFrame, key: list[str]) -> DataFrame:
    """Each value with its key, as one column `part`, for `fold`."""
    return routed(values).select(*key, F.struct(*_PART).alias("part"))


def fold(values: DataFrame | list[DataFrame], key: list[str], every: DataFrame | None = None) -> DataFrame:
    """One row an item: its fields, metadata, the kinds of its metadata, confidence and source cells; the last value in `ord` wins a name.

    What a field could not take stands in the metadata beside an earlier value that it could. `every` holds the keys of
    all items, those without a value too. A list holds values by `parts_of`, each gathered where it lies, and needs `every`.
    """
    if isinstance(values, list):
        gathered, held = every, [f"_v{i}" for i in range(len(values))]
        for name, part in zip(held, values, strict=True):
            gathered = gathered.join(part.groupBy(*key).agg(F.collect_list("part").alias(name)), key, "left")
        none = F.array().cast(gathered.schema[held[0]].dataType)
        gathered = gathered.withColumn("v", F.sort_array(F.concat(*[F.coalesce(name, none) for name in held]))).drop(*held)
    else:
        gathered = values.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*_PART))).alias("v"))
        if every is not None:
            gathered = every.join(gathered, key, "left").withColumn("v", F.coalesce("v", F.filter(F.array(F.lit(None).cast(gathered.schema["v"].dataType.elementType)), lambda x: x.isNotNull())))
    part = lambda name: {"quantity": "as_int", "delivery_date": "as_date"}.get(name, "as_text")
    of = lambda name: F.try_element_at("_own", F.lit(name))[part(name)]

    def last(items: str) -> Column:
        """Of repeated names the last stands alone before a map is made; few items have any, and only theirs are searched."""
        repeated = F.size(F.array_distinct(F.col(items)["canonical"])) < F.size(items)
        return F.when(repeated, F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y["canonical"] == x["canonical"]))).otherwise(F.col(items))

    # Names in order once, for all maps over them.
    named_first = lambda items: F.sort_array(F.transform(items, lambda x: F.struct(x["canonical"], x["sval"], x["dtype"], x["confidence"], x["addr"])))
    pairs = lambda items, value: F.map_from_arrays(F.col(items)["canonical"], F.col(items)[value])
    split = gathered.withColumns({"_fields": F.filter("v", lambda x: x["is_field"]), "_rest": F.filter("v", lambda x: ~x["is_field"])})
    lasts = split.withColumns({"_fields": last("_fields"), "_rest": named_first(last("_rest")), "_all": named_first(last("v"))})
    items = lasts.withColumn("_own", F.map_from_arrays(F.col("_fields")["canonical"], F.col("_fields")))
    return promoted(items.select(*key, *[of(n).alias(n) for n in vocab.ITEM_FIELDS], pairs("_rest", "sval").alias("metadata"), pairs("_rest", "dtype").alias("metadata_kinds"), pairs("_all", "confidence").alias("confidence"), pairs("_all", "addr").alias("cells")))


def promoted(items: DataFrame) -> DataFrame:
    """An item without io_number takes its metadata's buyer_po_no."""
    spare = F.when(F.col("io_number").isNull(), F.try_element_at("metadata", F.lit("buyer_po_no")))
    rest = lambda name: F.when(spare.isNotNull(), F.map_filter(name, lambda k, _: k != "buyer_po_no")).otherwise(F.col(name))
    return items.withColumns({"io_number": F.coalesce("io_number", spare), **{c: rest(c) for c in ("metadata", "metadata_kinds") if c in items.columns}})


def item_rows(roles: DataFrame) -> DataFrame:
    """(r, sub_rows) of the data rows that make an item: each, but in a group whose rows all have a role of their own only the
    anchor, with the others as sub-rows."""
    data = roles.where("role in ('anchor', 'child')")
    if "sub_row_role" not in roles.columns:
        return data.select(*SHEET, "r", F.lit(None).cast("array<struct<r:int,sub_row_role:string>>").alias("sub_rows"))
    grouped = data.withColumn("_group", F.coalesce("group_id", "r")).groupBy(*SHEET, "_group").agg(
        F.min(F.col("sub_row_role").isNotNull()).alias("many"), F.min(F.when(F.col("role") == "anchor", F.col("r"))).alias("anchor"), F.array_sort(F.collect_list(F.struct("r", "sub_row_role"))).alias("all")
    )
    one = grouped.where("many and anchor is not null").select(*SHEET, F.col("anchor").alias("r"), F.filter("all", lambda x: x["r"] != F.col("anchor")).alias("sub_rows"))
    each = grouped.where("not many or anchor is null").select(*SHEET, F.explode("all").alias("x")).select(*SHEET, "x.r", F.lit(None).cast("array<struct<r:int,sub_row_role:string>>").alias("sub_rows"))
    return one.unionByName(each)


def row_values(cells: DataFrame, merges: DataFrame, data: DataFrame, labels: DataFrame) -> DataFrame:
    """The values of data rows (r) under labels (c, canonical), looked up through merged regions."""
    own, through = look_rows(cells, merges, data, labels, _of_header)
    return own.unionByName(through)


def row_parts(cells: DataFrame, merges: DataFrame, data: DataFrame, labels: DataFrame) -> list[DataFrame]:
    """The same for `fold`, in two parts: what cells of their own hold, which stays in its buckets, and what regions show."""
    return look_rows(cells, merges, data, labels, lambda seen: parts_of(_of_header(seen), [*SHEET, "r"]))


def _of_header(seen: DataFrame) -> DataFrame:
    return seen.withColumns({"source": F.lit("header"), "ord": F.struct(F.lit(0).alias("k"), F.lit(0).alias("label_row"), F.col("c"))})


def key_values_of(cells: DataFrame, keyed: DataFrame) -> DataFrame:
    """The values of key-value pairs (canonical, value_row, value_col, label_row): the cell itself, merged or not."""
    at = keyed.withColumnsRenamed({"value_row": "r", "value_col": "c"})
    seen = at.join(cells.select(*SHEET, "r", "c", "dtype", "sval", "nval", "dval"), [*SHEET, "r", "c"])
    return seen.withColumns({"source": F.lit("kv"), "ord": F.struct(F.lit(1).alias("k"), F.col("label_row"), F.col("c")), "addr": address(F.col("r"), F.col("c"))})


def items_by_row(cells: DataFrame, merges: DataFrame, roles: DataFrame, names: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """An item for each anchor and child row, its cells looked up through merged regions."""
    labels = named(header_labels(cells, roles, claimed), names)
    data = item_rows(roles).select(*SHEET, "r")
    return fold(row_parts(cells, merges, data, labels.select(*SHEET, "c", "canonical")), [*SHEET, "r"], data)


def items_by_keys(cells: DataFrame, keyed: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """An item for each `key` (a sheet, or a block of one) from its key-value pairs; later pairs win."""
    values = named(keyed.withColumnRenamed("label", "raw"), names)
    return fold(routed(key_values_of(cells, values)), key)


def stages_wide(cells: DataFrame, merges: DataFrame, data: DataFrame, columns: DataFrame) -> DataFrame:
    """(r, stage, planned_date, metadata) for each data row and stage with a value in its primary column."""
    heads = columns.select(*SHEET, "stage", F.col("primary_col").alias("c")).distinct()
    primary = look(cells, merges, data.select(*SHEET, "r").join(heads, SHEET), heads).withColumns({"kind": F.col("dtype"), "day": F.to_date("dval")})
    subs = columns.where("sub_col is not null").select(*SHEET, "stage", "sub_label", F.col("sub_col").alias("c"))
    more = look(cells, merges, data.select(*SHEET, "r").join(subs, SHEET), subs).withColumn("day", F.to_date("dval"))
    shown = F.when(F.col("dtype") == "date", F.col("day").cast("string")).otherwise(F.col("sval"))
    meta = more.groupBy(*SHEET, "r", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lower("sub_label"), shown)))).alias("metadata"))
    return primary.select(*SHEET, "r", "stage", F.when(F.col("kind") == "date", F.col("day")).alias("planned_date"), "addr").join(meta, [*SHEET, "r", "stage"], "left")


STAGE = "name string, planned_date date, quantity bigint, section string, metadata map<string,string>, confidence double, rows array<int>, cells map<string,string>"


def stage_list(cells: DataFrame, merges: DataFrame, places: DataFrame, bands: DataFrame, columns: DataFrame, buckets: int | None = None) -> DataFrame:
    """(item, stages) for places (item, r): the stages of their bands, in order of bands and columns.

    `places` tells for which row an item reads each band (band). A stage needs a value in its primary column: of the
    item's row if the band is wide, of the band's plan row if it is tall. Sub-columns of a wide band fill the stage's
    fields or its metadata, sub-rows of a tall one its metadata. A stage or sub-column named ignore is not in `columns`.
    """
    heads = columns.select(*SHEET, F.col("r").alias("band"), F.col("stage").alias("raw_stage"), F.col("stage_name").alias("name"), F.col("primary_col").alias("c"), "first_col", "name_confidence").distinct()
    asked = places.join(bands.select(*SHEET, F.col("r").alias("band"), "title", "layout", "plan_row", "sub_rows"), [*SHEET, "band"]).join(heads, [*SHEET, "band"])
    wide = F.col("layout") == "wide_sub_columns"
    primary = look(cells, merges, asked.withColumnRenamed("r", "own_row").withColumn("r", F.when(wide, F.col("own_row")).otherwise(F.col("plan_row"))), heads.select(*SHEET, "c"))
    primary = stored(primary.drop("r").withColumnRenamed("own_row", "r"), buckets)
    stage = [*SHEET, "item", "band", "raw_stage"]
    found = primary.select(*stage, "name", "r", "title", "layout", "sub_rows", "c", "first_col", "name_confidence", F.when(F.col("dtype") == "date", F.to_date("dval")).alias("planned_date"), F.col("addr").alias("plan_addr"))
    subs = columns.where("sub_col is not null").select(*SHEET, F.col("r").alias("band"), F.col("stage").alias("raw_stage"), F.col("sub_name").alias("sub"), F.col("sub_col").alias("c"))
    beside = look(cells, merges, found.where("layout = 'wide_sub_columns'").select(*stage, "r").join(subs, [*SHEET, "band", "raw_stage"]), subs.select(*SHEET, "c"))
    own = cells.withColumn("addr", address(F.col("r"), F.col("c")))
    under = found.where("layout <> 'wide_sub_columns'").select(*stage, "c", F.explode("sub_rows").alias("sub", "r")).where("sub <> 'plan'").join(own, [*SHEET, "r", "c"])
    shown = F.when(F.col("dtype") == "date", F.to_date("dval").cast("string")).otherwise(F.col("sval"))
    more = beside.select(*stage, "sub", "c", "dtype", "nval", shown.alias("text"), "sval", "addr").unionByName(under.select(*stage, "sub", "c", "dtype", "nval", F.col("sval").alias("text"), "sval", "addr"))
    amount = F.when(F.col("sub") == "quantity", scalars.coerce_int(F.col("dtype"), F.col("sval"), F.col("nval")))
    plain = ~F.col("sub").isin(vocab.STAGE_FIELDS) | ((F.col("sub") == "quantity") & amount.isNull())
    last = more.groupBy(*stage, "sub").agg(F.max_by(F.struct("text", "addr", amount.alias("amount"), plain.alias("plain")), "c").alias("v"))
    entries = lambda where, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(where, F.struct("sub", value)))))
    extra = last.groupBy(*stage).agg(F.max("v.amount").alias("quantity"), entries(F.col("v.plain"), F.col("v.text")).alias("metadata"), entries(F.col("sub") != "planned_date", F.col("v.addr")).alias("sub_cells"))
    none = F.create_map().cast("map<string,string>")
    whole = found.join(extra, stage, "left")
    rows = F.when(F.col("layout") == "wide_sub_columns", F.array("r")).otherwise(F.array_sort(F.map_values("sub_rows")))
    cells_of = F.map_concat(F.create_map(F.lit("planned_date"), F.col("plan_addr")), F.coalesce("sub_cells", none))
    one = F.struct("band", "first_col", F.struct("name", "planned_date", "quantity", F.col("title").alias("section"), F.coalesce("metadata", none).alias("metadata"), F.coalesce("name_confidence", F.lit(vocab.CONFIDENCE["stage"])).alias("confidence"), rows.alias("rows"), cells_of.alias("cells")).alias("stage"))
    return whole.groupBy(*SHEET, "item").agg(F.transform(F.array_sort(F.collect_list(one), _in_order), lambda x: x["stage"]).alias("stages"))


def _in_order(a: F.Column, b: F.Column) -> F.Column:
    by = lambda x: F.struct(x["band"], x["first_col"])
    return F.when(by(a) < by(b), -1).when(by(a) > by(b), 1).otherwise(0)


def apply_plan(cells: DataFrame, merges: DataFrame, plan, names: DataFrame, buckets: int | None = None) -> DataFrame:
    """Items of all sheets by their plan's mode: (mode, item, fields, metadata, confidence, cells, rows, stages).

    `item` is the row of an item in row mode, the number of its block in section mode, 0 in sheet mode.
    """
    mode = lambda name: plan.sheets.where(F.col("mode") == name).select(*SHEET)
    label = lambda df, raw: naming.apply_names(df, names, "field", raw, "canonical")
    columns = naming.apply_names(plan.columns, names, "stage", "stage", "stage_name")
    subs = naming.apply_names(plan.columns.where("sub_label is not null").drop("name_confidence"), names, "subfield", "sub_label", "sub_name").select(*SHEET, "r", "stage", "sub_label", "sub_name")
    columns = columns.join(subs, [*SHEET, "r", "stage", "sub_label"], "left").withColumn("sub_col", F.when(F.col("sub_name").isNotNull(), F.col("sub_col")))
    key = [*SHEET, "item"]
    data = item_rows(plan.rows.join(mode("row"), SHEET, "left_semi")).withColumn("item", F.col("r"))
    heads = [part.withColumnRenamed("r", "item") for part in row_parts(cells, merges, data, label(plan.labels, "raw").select(*SHEET, "c", "canonical", "name_confidence"))]
    keyed = key_values_of(cells, label(plan.keys, "label"))
    common = ["canonical", "dtype", "sval", "nval", "dval", "source", "ord", "addr", "name_confidence"]
    in_rows = keyed.drop("r", "item").join(data.select(*key), SHEET)
    by_row = fold([*heads, parts_of(in_rows, key)], key, data.select(*key)).join(data.select(*key, "sub_rows"), key, "left")
    spread = F.transform("sub_rows", lambda x: F.struct(x["r"].alias("row"), x["sub_row_role"]))
    by_row = by_row.withColumn("metadata", F.when(F.size("sub_rows") > 0, F.map_concat("metadata", F.create_map(F.lit("multi_row_sub_rows"), F.to_json(spread)))).otherwise(F.col("metadata"))).drop("sub_rows")
    blocks = plan.blocks.withColumn("item", F.col("block_id").cast("int"))
    in_blocks = key_values_of(cells, label(plan.members.withColumn("item", F.col("block_id").cast("int")), "label"))
    by_block = fold(routed(in_blocks.select(*key, *common)), key, blocks.select(*key))
    whole = mode("sheet").withColumn("item", F.lit(0))
    by_sheet = fold(routed(keyed.join(mode("sheet"), SHEET, "left_semi").withColumn("item", F.lit(0)).select(*key, *common)), key, whole)
    tag = lambda df, name: df.withColumn("mode", F.lit(name))
    items = tag(by_row, "row").unionByName(tag(by_block, "section")).unionByName(tag(by_sheet, "sheet"))
    spans = data.select(*key, F.array("r").alias("rows")).unionByName(blocks.select(*key, F.sequence("start", "end").alias("rows"))).unionByName(whole.select(*key, F.array().cast("array<int>").alias("rows")))
    band = plan.bands.select(*SHEET, F.col("r").alias("band"), "plan_row", "block_id")
    places = (
        data.select(*key, "r").join(band.drop("plan_row", "block_id"), SHEET)
        .unionByName(band.where("block_id is not null").select(*SHEET, F.col("block_id").cast("int").alias("item"), F.col("plan_row").alias("r"), "band"))
        .unionByName(band.join(mode("sheet"), SHEET, "left_semi").select(*SHEET, F.lit(0).alias("item"), F.col("plan_row").alias("r"), "band"))
    )
    stages = stage_list(cells, merges, places, plan.bands.dropDuplicates([*SHEET, "r"]), columns, buckets)
    joined = items.join(spans, key).join(stages, key, "left")
    return joined.withColumn("stages", F.coalesce("stages", F.array().cast(joined.schema["stages"].dataType)))
