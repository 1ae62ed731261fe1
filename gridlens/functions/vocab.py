"""Fixed vocabularies of grid layouts, as plain word lists."""

#: Parts of header texts that mark a column of item identities.
IDENTITY = ["io no", "io number", "io", "job no", "job number", "po no", "po number", "buyer po", "buyer po no", "style no", "style code", "style"]
#: Labels that stand beside a value.
KEY_LABELS = [
    "job no", "io no", "io number", "po no", "buyer po no", "quantity", "qty", "order qty", "plan qty", "ex-fac date", "ex-fty date", "ex fac date", "ex factory",
    "delivery date", "order receipt", "shipment date", "style", "fabric", "color", "colour",
]
#: Labels of sub-columns and sub-rows of a stage band, and their roles.
SUB_LABELS = {"plan": "plan", "planned": "plan", "action": "action", "actual": "actual", "actl": "actual", "deviation": "deviation", "dev": "deviation"}
#: Words in a header that mark the first choice of identity column.
IDENTITY_FIRST = ["io", "job", "buyer po"]
#: Fields of an item; all others are metadata.
ITEM_FIELDS = ["io_number", "style_code", "style_name", "color_code", "color_name", "fabric_code", "delivery_date", "quantity"]
#: Header texts and the fields they stand for.
NAME_MAP = {
    "IO NO": "io_number", "IO": "io_number", "JOB NO": "io_number", "ORDER NO": "io_number", "STYLE": "style_code", "STYLE NO": "style_code",
    "COLOR": "color_code", "COLOUR": "color_code", "FABRIC": "fabric_code", "ORDER QTY": "quantity", "QUANTITY": "quantity", "QTY": "quantity",
    "EX FAC DATE": "delivery_date", "DELIVERY DATE": "delivery_date", "REMARK": "ignore",
}
#: Labels of fields and of what goes to the metadata, without punctuation, by the name they stand for.
FIELD_LABELS = {
    "io_number": ["io", "io no", "io number", "job", "job no", "job number"],
    "style_code": ["style no", "style number", "style code", "art no", "article no"],
    "style_name": ["style name", "style description"],
    "color_code": ["color", "colour", "color code", "colour code"],
    "color_name": ["color name", "colour name"],
    "fabric_code": ["fabric", "fabric code", "fabric quality", "material quality", "fabric type", "fabric description"],
    "quantity": ["quantity", "qty", "order qty", "order quantity", "plan qty", "required qty", "cut qty plan"],
    "delivery_date": ["delivery date", "delivery", "ex fac date", "ex fty date", "ex factory date", "ex factory", "etd", "eta", "etd ex factory as per p o", "shipment date"],
    "order_receipt_date": ["order receipt", "order receipt date"],
    "pps_completion": ["pps completion"],
    "sample_completion": ["sample completion"],
    "sample_dispatch": ["sample dispatch"],
    "buyer": ["buyer", "buyer name", "customer"],
    "season": ["season"],
    "factory": ["factory", "factory name"],
    "price": ["price", "fob", "unit price"],
    "balance_qty": ["balance qty", "balance quantity", "balance"],
    "cut_qty": ["cut qty", "cut quantity"],
    "sewing_qty": ["sewing qty", "sewing quantity"],
    "shipped_qty": ["shipped qty", "shipped quantity", "ship qty"],
    "ignore": ["remark", "remarks", "s no", "sno", "sl no"],
}
#: Labels that name the item where no label of io_number does, else the buyer's number.
BUYER_LABELS = ["buyer po no", "buyer po", "po no", "po number", "order no", "order ref"]
#: Names of stages, and the headers that stand for them beside their own words.
STAGES = [
    "fabric", "lab_dip_send", "lab_dip_approval", "fit_send", "fit_approval", "art_work_send", "art_work_approval", "in_house_fabric_send",
    "in_house_fabric_approval", "pre_production_send", "pre_production_approval", "first_pattern", "garment_pattern", "planned_completion_date", "size_set",
    "lot_card", "cutting", "feeding", "sewing", "sewing_start", "sewing_end", "final_inspection", "printing", "embroidery", "washing", "finishing", "packing",
    "ex_factory", "trims_inhouse",
]
STAGE_LABELS = {
    "ex_factory": ["ex factory shipment", "shipment"], "final_inspection": ["fi", "inspection"], "lab_dip_send": ["l d send"], "lab_dip_approval": ["l d approval"],
    "cutting": ["cut"], "sewing": ["sew"], "packing": ["pack"], "ignore": ["ex factory date", "ex fac date", "delivery date", "order qty", "quantity"],
}
#: Labels of a stage's sub-columns.
SUB_FIELDS = {"planned_date": ["plan", "planned"], "actual_date": ["actual", "actl"], "deviation_days": ["deviation", "dev"], "comments": ["comments"], "remarks": ["remarks"], "approval_date": ["approval", "approval date", "approved"], "received_date": ["received", "received date", "recvd"], "approved_qty": ["approved qty", "approved quantity"], "quantity": ["qty", "quantity"]}
#: Fields of a stage beside its name and source.
STAGE_FIELDS = ["planned_date", "quantity", "section", "metadata", "confidence"]
#: Names of sheets that hold no plan.
NOISE_SHEETS = ["lab", "log", "summary", "instructions", "info", "_sheet"]
#: Spellings of the header of a running number.
NUMBER_LABELS = ["s no", "s.no", "sno", "s. no", "sl no"]
#: Words in a header by which items are scored, by field; not those of the check.
SCORED_TERMS = {
    "io_number": ["po", "buyer", "io", "job", "order"],
    "style_code": ["style"],
    "color_code": ["color", "colour"],
    "fabric_code": ["fabric", "material", "quality"],
    "delivery_date": ["delivery", "ex factory", "etd", "ship"],
    "quantity": ["qty", "quantity"],
}
#: Names of the modes in results.
FORMATS = {"row": "row_per_pli", "section": "section_per_pli", "sheet": "sheet_is_pli"}
#: Confidence by where a value was found.
CONFIDENCE = {"kv": 0.95, "header": 0.85, "stage": 0.85, "subfield": 0.80, "metadata": 0.40}
#: Words that header rows are checked for, by field.
HEADER_TERMS = {
    "io_number": ["po", "buyer", "io", "job", "order ref", "order number", "order no"],
    "style_code": ["style"],
    "color_code": ["color", "colour"],
    "fabric_code": ["fabric", "material", "quality"],
    "delivery_date": ["delivery", "ex factory", "ex-fac", "ex fac", "etd", "ship"],
    "quantity": ["qty", "quantity", "order qty", "plan qty"],
}
#: Fields whose dropout is watched.
TRACKED = ["io_number", "style_code", "color_code", "fabric_code", "delivery_date", "quantity"]
