"""Column helpers for text, keys and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.params import CHUNK_PREFIX, RAW_PREFIX, SITE_HOST, SITE_PATH

# All Unicode white space, as a trim set.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

# Characters whose upper case is several characters, and which have no single-character upper case.
# The title rule leaves them as they are, whereas upper() would spell them out.
_SINGLE_UPPER = {*range(0x1F80, 0x1FB0), 0x1FB3, 0x1FBC, 0x1FC3, 0x1FCC, 0x1FF3, 0x1FFC}
NO_UPPER = "".join(chr(c) for c in range(0x10000) if c not in _SINGLE_UPPER and len(chr(c).upper()) > 1)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_all_caps(text: Column) -> Column:
    plain = F.translate(text, NO_UPPER, "")
    return F.upper(plain) == plain


def after_prefix(text: Column, prefix: str) -> Column:
    return F.substring(text, len(prefix) + 1, 2147483647)


def base64_text(text: Column) -> Column:
    """Standard base64 on one line; base64() breaks its lines."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def raw_object_key(url: Column) -> Column:
    return F.concat(F.lit(f"{RAW_PREFIX}/url="), base64_text(url))


def chunk_object_key(chunk_id: Column) -> Column:
    return F.concat(F.lit(f"{CHUNK_PREFIX}/"), chunk_id, F.lit(".txt"))


def chunk_id_of_key(key: Column) -> Column:
    """Last path part without its last dot part; empty when it has no dot."""
    name = F.substring_index(key, "/", -1)
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def resolve_href(href: Column, host: str = SITE_HOST, path: str = SITE_PATH) -> Column:
    return (
        F.when(href.startswith(f"//{host}"), F.concat(F.lit("https:"), href))
        .when(href.startswith(path), F.concat(F.lit(f"https://{host}"), href))
        .otherwise(href)
    )


def is_localhost_url(url: Column) -> Column:
    """True for localhost, 127.0.0.0/8 and ::1 hosts; false for anything else or an invalid URL."""
    host = F.try_parse_url(url, F.lit("HOST"))
    byte = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    zeros = r"(0{1,4}:){7}0{0,3}1|::(0{1,4}:){0,6}0{0,3}1"
    return F.coalesce(
        (host == "localhost") | host.rlike(rf"^127(\.{byte}){{3}}$") | host.rlike(rf"^\[({zeros})\]$"), F.lit(False)
    )
