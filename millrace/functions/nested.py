"""Arrays, structs and JSON text spread into flat columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Children spread from the two struct columns, and the JSON keys looked up.
STRUCT_CHILDREN = {
    "images": {
        "hi_res": "images_hi_res_url",
        "large": "images_large_url",
        "thumb": "images_thumb_url",
        "variant": "images_variant",
    },
    "videos": {
        "title": "videos_title",
        "url": "videos_url",
        "user_id": "videos_user_id",
    },
}
DETAIL_KEYS = ["Publisher", "Language", "Hardcover", "ISBN 10", "ISBN 13", "Item Weight", "Dimensions"]
IMAGE_FIELDS = ["attachment_type", "large_image_url", "medium_image_url", "small_image_url"]


def array_length(c: str) -> Column:
    """Array size, -1 for a NULL array (also under ANSI mode, where ``size`` gives NULL)."""
    return F.coalesce(F.size(F.col(c)), F.lit(-1))


def array_columns(c: str, copy: bool = True) -> dict[str, Column]:
    """``{c}_length`` and, unless switched off, the duplicate ``{c}_as_list``."""
    out = {f"{c}_length": array_length(c)}
    if copy:
        out[f"{c}_as_list"] = F.col(c)
    return out


def struct_firsts(c: str, children: dict[str, str]) -> dict[str, Column]:
    """First element of each child array of a struct of arrays."""
    return {name: F.get(F.col(c)[child], F.lit(0)) for child, name in children.items()}


def spread_structs(c: str, fields: Sequence[str], n: int = 3) -> dict[str, Column]:
    """The first ``n`` elements of an array of structs as ``{c}_{i}_{field}`` columns."""
    return {f"{c}_{i}_{f}": F.get(F.col(c), F.lit(i))[f] for i in range(n) for f in fields}


def key_name(key: str) -> str:
    return key.lower().replace(" ", "_")


def json_lookups(c: str, keys: Sequence[str], prefix: str) -> dict[str, Column]:
    """Presence flag and value of each key of a JSON object held as text."""
    parsed = F.from_json(F.col(c), "map<string,string>")
    out: dict[str, Column] = {}
    for key in keys:
        value = parsed[key]
        out[f"{prefix}_{key_name(key)}_exists"] = value.isNotNull()
        out[f"{prefix}_{key_name(key)}_value"] = value
    return out
