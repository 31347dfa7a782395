from nearhome.functions.codecs import csv_to_ids, ids_to_csv, json_field, similar_from_json, similar_to_json
from nearhome.functions.scores import interaction_weight
from nearhome.functions.vectors import cosine, l2_norm, unit

__all__ = [
    "csv_to_ids", "ids_to_csv", "json_field", "similar_from_json", "similar_to_json",
    "interaction_weight", "cosine", "l2_norm", "unit",
]
