"""Scalar functions over text, paths and keys, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names that mark a secret.
SECRET_WORDS = ("secret", "password", "passwd", "passphrase", "token", "apikey", "credential", "privatekey", "accesskey", "pwd")
#: Fixed value: what stands for a secret's value.
REDACTED = "<redacted>"


def normalised_key(key: Column) -> Column:
    """Words of ASCII letters and digits of a config key, lower case, joined by dots."""
    return F.lower(F.trim(F.regexp_replace(key, "[^A-Za-z0-9]+", "."), F.lit(".")))


def canonical_key(key: Column) -> Column:
    """Each dotted segment without other than ASCII letters and digits, lower case; empty segments go."""
    plain = F.regexp_replace(key, "[^A-Za-z0-9.]", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\.+", "."), F.lit(".")))


def slug(heading: Column) -> Column:
    """ASCII letters and digits of a heading, lower case, dashes between."""
    return F.lower(F.trim(F.regexp_replace(heading, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where text is cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = basename(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: ``**`` spans segments, ``*`` and ``?`` stay in one."""
    out = []
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part).replace("/", "/")))
    return "^" + "".join(out) + "$"


def secret_named(key: Column, words: tuple[str, ...] = SECRET_WORDS) -> Column:
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", "")).rlike("|".join(words))


def redacted(key: Column, value: Column) -> Column:
    """``value``, but :data:`REDACTED` where the key is named like a secret and there is a value."""
    return F.when(secret_named(key) & value.isNotNull(), REDACTED).otherwise(value)


def rounded(value: Column, places: int = 2) -> Column:
    return F.round(value * 10**places) / 10**places


def tokens(query: str) -> list[str]:
    return [t for t in re.split(r"::|\s+", query.strip().lower()) if t]


def image_reference(ref: Column) -> list[Column]:
    """Name, tag and digest of a container image reference."""
    digest = F.nullif(F.regexp_extract(ref, "@(.+)$", 1), F.lit(""))
    plain = F.regexp_replace(ref, "@.+$", "")
    tag = F.nullif(F.regexp_extract(plain, ":([^:/]+)$", 1), F.lit(""))
    return [F.regexp_replace(plain, ":[^:/]+$", "").alias("image"), tag.alias("tag"), digest.alias("digest")]


def version(text: Column) -> Column:
    """``major.minor`` as a struct that orders by number."""
    return F.struct(F.regexp_extract(text, r"^(\d+)\.(\d+)$", 1).cast("int").alias("major"), F.regexp_extract(text, r"^(\d+)\.(\d+)$", 2).cast("int").alias("minor"))


def normal_url(url: Column) -> Column:
    """A git url without trailing slashes and ``.git``, ASCII letters in lower case."""
    return F.translate(F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"(\.git)+\z", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repository(url: Column) -> Column:
    """Name of the repository in a git url: what follows the last slash or colon."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"(\.git)+\z", ""), r"([^/:]*)\z", 1)


# Endings and names that tell what a file is.
CONFIG_ENDINGS = ("toml", "json", "yaml", "yml", "env")
TOOLING_NAMES = ("cargo.toml", "cargo.lock", "rust-toolchain", "rust-toolchain.toml", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", "deny.toml", "release-plz.toml", ".gitlab-ci.yml")
PROSE_ENDINGS, AUDIO_ENDINGS, IMAGE_ENDINGS = ("md", "markdown", "txt", "rst", "adoc"), ("wav", "mp3", "flac"), ("png", "jpg", "jpeg")
#: Fixed value: characters of captured content.
CONTENT = 1500


def _ending(path: Column) -> Column:
    """Lower-case ending of the file's name as a path has it: a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1))


def config_path(path: Column) -> Column:
    """Whether a file holds configuration, by its ending or as ``.env`` or ``.env.<x>``; nothing below ``.github`` does."""
    name = F.lower(basename(path))
    return ~((path == ".github") | path.startswith(".github/")) & (_ending(path).isin(*CONFIG_ENDINGS) | (name == ".env") | name.startswith(".env."))


def tooling_path(path: Column) -> Column:
    """Whether a configuration is that of tools: below ``.github`` or ``.config``, cargo's own in ``.cargo``, or of a known name anywhere."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    name = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), path))
    own = (F.try_element_at(parts, F.lit(-2)) == ".cargo") & name.isin("config", "config.toml")
    return F.exists(parts, lambda s: s.isin(".github", ".config")) | F.coalesce(own, F.lit(False)) | name.isin(*TOOLING_NAMES)


def path_kind(path: Column) -> Column:
    """prose, audio, image, or null, by the ending."""
    e = _ending(path)
    return F.when(e.isin(*PROSE_ENDINGS), "prose").when(e.isin(*AUDIO_ENDINGS), "audio").when(e.isin(*IMAGE_ENDINGS), "image")


def captured(text: Column) -> Column:
    """Content as it is kept: white space collapsed, :data:`CONTENT` characters, trimmed."""
    return F.trim(F.substring(collapsed(text), 1, CONTENT))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def snippet_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a snippet without the white space around it."""
    return F.substring(F.sha2(F.regexp_replace(text, r"^\s+|\s+\z", ""), 256), 1, 16)


def canonical_parts(parts: list[Column]) -> Column:
    """Parts one after another, each after its length in bytes and a colon, so no part can pass for the end of another."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def json_field(json: Column, paths: list[str]) -> Column:
    """The first of some JSON paths that has a value, as text."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def without_code(text: Column) -> Column:
    """Text without its code spans: what stands between two runs of as many backticks goes, with them."""
    return F.regexp_replace(text, r"(?s)(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", "")


def wiki_links(text: Column) -> Column:
    """What stands in ``[[...]]`` outside code spans, trimmed."""
    found = F.regexp_extract_all(without_code(text), F.lit(r"\[\[(.*?)\]\]"), 1)
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def unix_seconds(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY-MM-DD`` or of a time ``YYYY-MM-DDThh:mm:ss`` with an offset, ``Z`` or neither; fractions are dropped. Null for any other text."""
    shape = r"\A(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2})[^\n](\d{2})[^\n](\d{2})(?:\.\d*)?([Zz]|([+-])(\d{2}):?(\d{2}))?)?\z"
    part = lambda n: F.regexp_extract(text, shape, n)
    number = lambda n: part(n).try_cast("bigint")
    timed, away = part(4) != "", part(8) != ""
    year, month, day = number(1), number(2), number(3)
    ok = text.rlike(shape) & month.between(1, 12) & day.between(1, 31)
    ok = ok & (~timed | ((number(4) <= 23) & (number(5) <= 59) & (number(6) <= 60)))
    # days of months that are shorter run on into the next one
    first = F.datediff(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = F.when(timed, number(4) * 3600 + number(5) * 60 + number(6)).otherwise(0)
    offset = F.when(away, (number(9) * 3600 + number(10) * 60) * F.when(part(8) == "-", -1).otherwise(1)).otherwise(0)
    return F.when(ok, (first + day - 1) * 86_400 + clock - offset)


def rfc3339(seconds: Column) -> Column:
    """The UTC time of seconds since 1970, ``YYYY-MM-DDThh:mm:ssZ``; times before are 1970 itself."""
    at = F.greatest(seconds, F.lit(0))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86_400).cast("int")), "yyyy-MM-dd")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = at % 86_400
    return F.when(seconds.isNotNull(), F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z")))


def age_in_days(since: Column, until: Column) -> Column:
    """Whole days between two such texts, cut towards zero; null if either is none."""
    seconds = unix_seconds(until) - unix_seconds(since)
    return F.when(seconds < 0, F.ceil(seconds / 86_400)).otherwise(F.floor(seconds / 86_400))
