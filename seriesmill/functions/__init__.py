from seriesmill.functions.escape import path_escape, query_escape, unescape
from seriesmill.functions.paths import (
    ancestor_prefixes,
    canonical_path,
    canonical_tags,
    is_tagged,
    path_level,
    reverse_path,
    squeeze_dots,
    tag_list,
)

__all__ = [
    "ancestor_prefixes", "canonical_path", "canonical_tags", "is_tagged", "path_escape", "path_level",
    "query_escape", "reverse_path", "squeeze_dots", "tag_list", "unescape",
]
