"""Schemas of raw records and of the state."""

from __future__ import annotations

OPTION = "struct<id:string,name:string,stock:string,available_in:string,ean:string>"
RAW_RECORD = (
    "source_record long, byte_end long, id string, name string, creation_date string, brand string, category_path string, "
    "category struct<id:string,name:string>, color string, type string, images array<string>, price string, description string, "
    f"options array<{OPTION}>, supplier_warnings array<string>, skip boolean, skip_reason string"
)
HASHES = ("core", "price", "stock", "attribute", "feature", "category", "combination", "combination_stock", "specific_price", "image", "payload")
MAPPING = "id_shop long, source string, source_key string, id_product long, " + ", ".join(f"{h}_hash string" for h in HASHES) + ", out_of_feed boolean, last_seen_run_id long"
