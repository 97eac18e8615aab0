"""One spelling for the address of a stored object.

The same file is listed as ``/x``, ``file:/x`` or ``file:///x``, the same object
as ``s3://`` or ``s3a://``, with or without percent escapes, depending on who
made the listing. Addresses are compared in canonical form only:
``scheme://authority/path``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Schemes that name the same store, and ports that may be left out.
SAME_STORE = {"s3n?": "s3a", "abfs": "abfss", "wasb": "wasbs"}
DEFAULT_PORT = {"hdfs": "8020"}

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unescape(path: Column) -> Column:
    """%XX decoded once; a plus sign and a stray % stay as they are."""
    sound = F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(sound, F.lit("+"), F.lit("%2B")))


def _decoded(path: Column, escapes: int) -> Column:
    """``_unescape`` so often; an address without an escape is left alone."""
    c = path
    for _ in range(escapes):
        c = _let(c, lambda x: F.when(F.contains(x, F.lit("%")) & x.rlike("%[0-9A-Fa-f]{2}"), _unescape(x)).otherwise(x))
    return c


def _renamed(head: str) -> str:
    """Scheme and authority in canonical form."""
    head = head.lower()
    for names, kept in SAME_STORE.items():
        head = re.sub(f"^{names}://", f"{kept}://", head)
    for name, port in DEFAULT_PORT.items():
        head = re.sub(f"^({name}://[^/]*):{port}$", r"\1", head)
    return head


def _with_scheme(c: Column, default_scheme: str, default_authority: str) -> Column:
    """An address that does not begin with a slash: scheme and authority canonical."""
    replace = F.regexp_replace
    c = replace(c, f"^(?!{_SCHEME}:/)/*", f"{default_scheme}://{default_authority}/")
    c = replace(replace(c, f"^({_SCHEME}):/(?!/)", "$1:///"), f"^({_SCHEME}):/{{3,}}", "$1:///")
    c = _let(c, lambda x: F.concat(F.lower(F.regexp_extract(x, "^[^/]*//[^/]*", 0)), replace(x, "^[^/]*//[^/]*", "")))
    if default_authority:
        c = replace(c, f"^{default_scheme}:///", f"{default_scheme}://{default_authority}/")
    for names, kept in SAME_STORE.items():
        c = replace(c, f"^{names}://", f"{kept}://")
    for name, port in DEFAULT_PORT.items():
        c = replace(c, f"^({name}://[^/]*):{port}(?=/|$)", "$1")
    return c


def _tidy(c: Column) -> Column:
    """Repeated slashes, ``/./`` and a closing slash removed; each pattern is tried only where it can match."""
    replace = F.regexp_replace
    c = _let(c, lambda x: F.when(F.contains(x, F.lit("/./")), replace(x, r"/(\./)+", "/")).otherwise(x))
    c = _let(c, lambda x: F.when(F.contains(F.substr(x, F.locate("://", x) + 3), F.lit("//")),
                                 replace(x, "(?<!:)(?<!:/)/{2,}", "/")).otherwise(x))
    # $ also matches before a closing line break
    return _let(c, lambda x: F.when(F.substring(x, -1, 1).isin("/", *"\n\r\u0085\u2028\u2029"), replace(x, "(?<!/)/$", "")).otherwise(x))


def canonical(address, escapes: int = 0, default_scheme: str = "file", default_authority: str = "") -> Column:
    """Canonical form of an address.

    Scheme and authority in small letters, schemes of one store made one,
    a default port dropped, an address without a scheme put on the default
    file system; repeated slashes, ``/./`` and a closing slash removed. ``escapes`` is how
    often the path is percent-decoded: 0 for a raw path (``binaryFile``), 1 for a URI
    (``_metadata.file_path``, ``input_file_name()``). NULL stays NULL.
    """
    c = F.col(address) if isinstance(address, str) else address
    home = _renamed(f"{default_scheme}://{default_authority}") + "/"
    placed = _let(c, lambda x: F.when(F.startswith(x, F.lit("/")), F.concat(F.lit(home), F.ltrim(x, F.lit("/"))))
                  .otherwise(_with_scheme(x, default_scheme, default_authority)))
    return _tidy(_decoded(placed, escapes))


#: Decoding so often makes any two spellings of a path equal, however often they
#: were escaped. Two files whose names differ by escapes only become one, so use
#: it only where taking a file for a live one is the safe mistake.
ANY_SPELLING = 3


def default_filesystem(spark: SparkSession) -> tuple[str, str]:
    """Scheme and authority that an address without a scheme belongs to."""
    where = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    scheme, authority = re.match(r"([^:/]+):(?://([^/]*))?", where).groups()
    return scheme.lower(), (authority or "").lower()


def folder(address: Column) -> Column:
    """Everything before the last slash of a canonical address."""
    return F.regexp_replace(address, "/[^/]*$", "")
