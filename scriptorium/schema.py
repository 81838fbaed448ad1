"""The document model: one struct per document, wide nullable structs for the block union."""

CELL = "STRUCT<text STRING, uncertain BOOLEAN, struck BOOLEAN>"
PAIR = "STRUCT<key STRING, value STRING, uncertain BOOLEAN>"
BLOCK = (
    "STRUCT<type STRING, text STRING, level INT, items ARRAY<STRING>, ordered BOOLEAN, "
    f"pairs ARRAY<{PAIR}>, checked BOOLEAN, uncertain BOOLEAN, confidence DOUBLE, header_rows INT, "
    f"rows ARRAY<ARRAY<{CELL}>>>"
)
PAGE = f"STRUCT<page_number INT, notes STRING, blocks ARRAY<{BLOCK}>>"
DOCUMENT = f"title STRING, language STRING, handwritten BOOLEAN, pages ARRAY<{PAGE}>"
#: The block types of the model.
BLOCK_TYPES = ("heading", "paragraph", "list", "table", "key_value", "checkbox", "signature", "figure")
