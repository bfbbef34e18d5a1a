"""Scalar functions over contents, addresses, hosts and names.

Text is UTF-8, and a byte that is no part of a character counts as one. Lengths in rules are of bytes.
"""

from __future__ import annotations

import codecs
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import fixed
from palisade.functions.needles import found, likely
from palisade.functions.paths import any_of, contains_any, ends_any, is_home_scoped, is_package_churn
from palisade.functions.regex import all_matches, matches


def _mend(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


@F.pandas_udf(T.StringType())
def mended(contents: pd.Series) -> pd.Series:
    """Bytes that aren't UTF-8 throughout; each stray one as U+FFFD. The JVM would take several as one, hence Python."""
    codecs.register_error("stray", _mend)
    return contents.map(lambda c: None if c is None else bytes(c).decode("utf-8", "stray"))


def as_text(content: Column) -> Column:
    """Contents as text."""
    text = content.cast("string")
    sound = F.is_valid_utf8(text)
    return F.when(sound, text).otherwise(mended(F.when(~sound, content)))


def bytes_as_characters(content: Column) -> Column:
    """Bytes as characters of the same numbers."""
    return F.decode(content, "ISO-8859-1")


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\Asha256:[0-9a-fA-F]{64}\z"), F.lit(False))


def truncate(value: Column, size: int, trim: bool = True) -> Column:
    """At most size bytes of a string; a cut is marked by an ellipsis."""
    v = F.regexp_replace(value, r"\A\s+|\s+\z", "") if trim else value
    return F.when(F.octet_length(v) > size, F.concat(F.substring(v.cast("binary"), 1, size).cast("string"), F.lit("…"))).otherwise(v)


def max_line_length(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), lambda line: F.octet_length(line)))


def max_line_bytes(content: Column) -> Column:
    """The longest line of a file, in bytes."""
    return F.array_max(F.transform(F.split(bytes_as_characters(content), "\n"), lambda line: F.char_length(line)))


def is_minified(content: Column) -> Column:
    return max_line_bytes(content) > 2000


def is_binary(content: Column) -> Column:
    return F.instr(bytes_as_characters(F.substring(content, 1, 8000)), "\0") > 0


def is_printable(content: Column) -> Column:
    """No NUL, and 90 of 100 bytes are printable ASCII or common blanks."""
    text = bytes_as_characters(content)
    size = F.octet_length(content)
    shown = size - F.char_length(F.regexp_replace(text, r"[\x20-\x7e\n\r\t]", ""))
    return (size > 0) & (F.instr(text, "\0") == 0) & (F.floor(shown * 100 / size) >= 90)


def decoded_network_indicator(text: Column) -> Column:
    """The first of 60 base64 literals that decodes to readable text with an address, that text; else null."""
    found = F.transform(all_matches(text, fixed.B64_LITERAL, 1, 60), lambda x: F.when((F.length(x) <= 8192) & (F.length(x) % 4 == 0), F.try_to_binary(x, F.lit("base64"))))
    # what is printable for the most part is matched as text; a stray byte can't be part of a URL or an address
    good = F.filter(found, lambda x: x.isNotNull() & is_printable(x) & matches(x.cast("string"), fixed.URL_OR_IP))
    return F.regexp_replace(F.get(good, F.lit(0)).cast("string"), r"\A[\s\x85\xA0]+|[\s\x85\xA0]+\z", "")


_QUOTED = re.compile(fixed.QUOTED_STRING)
_QUOTED_IP = re.compile(fixed.QUOTED_IPV4, re.ASCII)
_ROLE = re.compile(fixed.NET_ROLE_BEFORE.replace(r"\s", r"[\t\n\f\r ]").replace("$", r"\Z"), re.ASCII)


@F.pandas_udf(T.StringType())
def strip_long_literals(texts: pd.Series) -> pd.Series:
    """String literals of over 200 bytes as empty ones. A callback on matches, hence Python; setup files only."""
    return texts.map(lambda t: None if t is None else _QUOTED.sub(lambda m: '""' if len(m.group().encode()) > 200 else m.group(), t))


def public_address(a: int, b: int, c: int, d: int) -> bool:
    """An IPv4 address that source code could really mean: no private, reserved, documentation or placeholder one."""
    if max(a, b, c, d) > 255 or a in (0, 10, 127) or a >= 224 or a == b == c == d:
        return False
    nets = ((172, 16 <= b <= 31), (192, b == 168 or (b == 0 and c == 2)), (169, b == 254), (100, 64 <= b <= 127), (198, b == 51 and c == 100), (203, b == 0 and c == 113), (8, b == 8 and c in (4, 8)))
    return not any(a == net and inside for net, inside in nets) and (a, b, c, d) not in ((1, 1, 1, 1), (1, 2, 3, 4))


@F.pandas_udf(T.StringType())
def hardcoded_endpoint(texts: pd.Series) -> pd.Series:
    """The first of 200 quoted public addresses with a network role in the 24 bytes before it. The look-back is cut by
    bytes and may begin inside a word, hence Python; texts with a quoted address only."""

    def find(text: str | None) -> str | None:
        for n, m in enumerate(_QUOTED_IP.finditer(text or "")):
            if n == 200:
                return None
            octets = m.groups()
            if public_address(*map(int, octets)) and _ROLE.search(text[max(0, m.start() - 24) : m.start()].encode()[-24:].decode("utf-8", "replace")):
                return ".".join(octets)
        return None

    return texts.map(find)


def hardcoded_public_endpoint(text: Column) -> Column:
    return hardcoded_endpoint(F.when(matches(text, fixed.QUOTED_IPV4), text))


def _octets(address: Column) -> list[Column]:
    return [F.get(F.split(address, r"\."), F.lit(i)).try_cast("int") for i in range(4)]


def is_public_ip(address: Column) -> Column:
    """The static rules' test of a dotted quad, see public_address."""
    a, b, c, d = _octets(address)
    shape = address.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    outside = any_of([F.greatest(a, b, c, d) > 255, a.isin(0, 10, 127), a >= 224, (a == b) & (b == c) & (c == d), (a == 172) & b.between(16, 31), (a == 192) & (b == 168), (a == 169) & (b == 254), (a == 100) & b.between(64, 127), (a == 192) & (b == 0) & (c == 2), (a == 198) & (b == 51) & (c == 100), (a == 203) & (b == 0) & (c == 113), (a == 8) & (b == 8) & c.isin(4, 8), address.isin("1.1.1.1", "1.2.3.4")])
    return F.coalesce(shape & ~outside, F.lit(False))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
#: What an IPv6 address that stands for an IPv4 one begins with.
_MAPPED = r"(?:(?:0{1,4}:){5}|::(?:0{1,4}:){0,4}|(?:0{1,4}:){1,4}:(?:0{1,4}:){0,3})ffff:"


def as_ipv4(address: Column) -> Column:
    """The dotted quad that an address is or stands for (as sockets of both kinds report it), else null."""
    low = F.lower(address)
    half = lambda g: F.conv(F.regexp_extract(low, rf"\A{_MAPPED}([0-9a-f]{{1,4}}):([0-9a-f]{{1,4}})\z", g), 16, 10).cast("int")
    pairs = [F.shiftright(half(1), 8), half(1).bitwiseAND(255), F.shiftright(half(2), 8), half(2).bitwiseAND(255)]
    return (
        F.when(address.rlike(rf"\A{_QUAD}\z"), address)
        .when(low.rlike(rf"\A{_MAPPED}{_QUAD}\z"), F.substring_index(low, ":", -1))
        .when(low.rlike(rf"\A{_MAPPED}[0-9a-f]{{1,4}}:[0-9a-f]{{1,4}}\z"), F.concat_ws(".", *pairs))
    )


def is_routable_public_ip(address: Column) -> Column:
    """The behaviour rules' test: routable, and no well-known resolver by its usual name."""
    quad = as_ipv4(address)
    a, b, c, _ = _octets(quad)
    shape = quad.isNotNull()
    outside = any_of([a.isin(10, 127), a >= 224, (a == 172) & b.between(16, 31), (a == 192) & (b == 168), (a == 169) & (b == 254), (a == 100) & b.between(64, 127), (a == 192) & (b == 0) & (c == 2), (a == 198) & (b == 51) & (c == 100), (a == 203) & (b == 0) & (c == 113), quad == "0.0.0.0", address.isin(fixed.PUBLIC_RESOLVERS)])
    return F.coalesce(shape & ~outside, F.lit(False))


def connects_hardcoded_ip(address: Column, hostnames: Column) -> Column:
    """A public address that no host name stands behind."""
    named = F.exists(F.coalesce(hostnames, F.array().cast("array<string>")), lambda h: (h != "") & (h != address))
    return ~named & is_routable_public_ip(address)


def is_metadata_endpoint(address: Column) -> Column:
    return address.isin(fixed.METADATA_ADDRESSES)


def is_mining_port(port: Column) -> Column:
    return port.isin(fixed.MINING_PORTS)


def bare_host(host: Column) -> Column:
    """Lower case, one trailing dot dropped."""
    return F.lower(F.regexp_replace(host, r"\.\z", ""))


def under_any(host: Column, suffixes: list[str]) -> Column:
    """The host is one of the domains or lies under one."""
    return host.isin(suffixes) | ends_any(host, ["." + s for s in suffixes])


def is_unknown_domain(ecosystem: Column, host: Column) -> Column:
    """Neither local nor one of the ecosystem's registries."""
    h = bare_host(host)
    known = [(ecosystem == eco) & (h.isin([s.removeprefix(".") for s in hosts]) | ends_any(h, hosts)) for eco, hosts in fixed.REGISTRY_HOSTS.items()]
    return F.coalesce(~(h.isin("", "localhost") | h.endswith(".local") | any_of(known)), F.lit(False))


def parent_domain(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) <= 2, host).otherwise(F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1)))


def install_fetch_allowed(host: Column) -> Column:
    return under_any(bare_host(host), fixed.INSTALL_FETCH_ALLOWED)


def is_ephemeral_tunnel(host: Column) -> Column:
    return under_any(F.lower(host), fixed.EPHEMERAL_TUNNELS)


def looks_executable_path(path: Column) -> Column:
    """A place to drop payloads in, and a script's ending or none."""
    p = F.lower(path)
    # Fixed values.
    place = contains_any(p, ["/tmp/", "/dev/shm/", "/var/tmp/"]) | is_home_scoped(p)
    return place & (ends_any(p, [".sh", ".py", ".elf", ".bin", ".out"]) | ~F.substring_index(p, "/", -1).contains("."))


def is_dropped_payload(path: Column) -> Column:
    return looks_executable_path(path) & ~is_package_churn(path)


def classify_read(path: Column) -> Column:
    """Struct class, severity of a sensitive path, or null. The first line that holds decides."""
    p = F.lower(path)
    home = is_home_scoped(p)
    # Fixed values.
    rules = [
        (home & contains_any(p, ["/.aws/credentials", "/.aws/config"]), "aws-credentials", "high"),
        (home & p.contains("/.ssh/id_"), "ssh-private-key", "high"),
        (home & p.endswith("/.npmrc"), "npm-token", "info"),
        (home & p.endswith("/.docker/config.json"), "docker-config", "high"),
        (home & ends_any(p, ["/.git-credentials", "/.gitconfig"]), "git-credentials", "high"),
        (home & ends_any(p, ["/.netrc", "/_netrc"]), "netrc", "info"),
        (home & contains_any(p, ["/.config/gcloud", "/.azure/", "/.kube/config"]), "cloud-config", "high"),
        (home & (p.endswith("/.env") | p.contains("/.env.")), "dotenv", "high"),
        (p == "/etc/shadow", "etc-shadow", "info"),
        (p == "/etc/passwd", "etc-passwd", "info"),
        (home & ends_any(p, ["/.bashrc", "/.bash_profile", "/.profile"]), "shell-rc", "low"),
    ]
    return _first(rules, "class", "severity")


def classify_write(path: Column) -> Column:
    """Struct rule, severity, description, or null."""
    p = F.lower(path)
    # Fixed values.
    persistent = any_of([
        contains_any(p, ["/etc/cron", "/var/spool/cron", "crontab", "/etc/systemd/system/", "/lib/systemd/system/", "/.config/systemd/user/", "/.config/autostart/", "/.git/hooks/"]),
        p.endswith("/.ssh/authorized_keys"), p == "/etc/ld.so.preload", is_home_scoped(p) & ends_any(p, ["/.bashrc", "/.bash_profile", "/.profile", "/.zshrc", "/.zprofile"]),
    ])
    system = any_of([p.startswith(d) for d in ["/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/"]])
    return _first([(persistent, *fixed.WRITE_RULES["persistence"]), (system, *fixed.WRITE_RULES["system"])], "rule", "severity", "description")


def classify_command(argv: Column) -> Column:
    """Struct rule, severity, description, or null."""
    line = F.lower(F.array_join(argv, " "))
    told = fixed.COMMAND_RULES
    rule, severity, words = told["network"]
    rules = [
        (contains_any(line, fixed.METADATA_WORDS), *told["metadata"]),
        (matches(line, fixed.RUNTIME_REVERSE_SHELL), *told["shell"]),
        (matches(line, fixed.RUNTIME_DESTRUCTIVE), *told["destructive"]),
        (contains_any(line, fixed.MINER_WORDS), *told["miner"]),
        *[(line.contains(w), rule, severity, words.format(w.strip())) for w in fixed.NETWORK_WORDS],
    ]
    return _first(rules, "rule", "severity", "description")


def recon_tool(argv: Column) -> Column:
    """Name of the host-profiling tool that a command runs, or null. Of several the first in the list."""
    line = F.concat(F.lit(" "), F.lower(F.array_join(argv, " ")), F.lit(" "))
    last = F.when(F.size(argv) > 0, F.lower(F.trim(F.element_at(argv, -1))) == "id")
    out = F.when(F.coalesce(last, F.lit(False)), "id")
    for word, name in reversed(fixed.RECON_WORDS):
        out = F.when(line.contains(word), name).otherwise(out)
    return out


def _first(rules: list[tuple], *names: str) -> Column:
    out = None
    for condition, *values in rules:
        value = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names, strict=True)])
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def hex_obfuscated(text: Column, low: Column) -> Column:
    """Of the first 200 hexadecimal identifiers at least 8, and 5 different ones."""
    names = all_matches(text, fixed.HEX_IDENTIFIER, most=200)
    return likely(low, fixed.HEX_IDENTIFIER) & (F.size(names) >= 8) & (F.size(F.array_distinct(names)) >= 5)


def host_recon_exfil(text: Column, low: Column) -> Column:
    calls = F.transform(all_matches(text, fixed.HOST_RECON, most=50), F.lower)
    return likely(low, fixed.HOST_RECON) & found(text, low, fixed.NET_PRIMITIVE) & (F.size(F.array_distinct(calls)) >= 2)


def shell_recon_exfil(text: Column, low: Column) -> Column:
    return found(text, low, fixed.SHELL_RECON_EXFIL)


def py_obfuscated(text: Column, low: Column, size: Column) -> Column:
    """eval of an escaped literal; or 40 escapes, over a quarter of the text, beside dynamic execution."""
    escapes = all_matches(text, fixed.ESCAPE_SEQUENCE, most=4000)
    escaped = F.char_length(F.array_join(escapes, ""))
    dense = (F.size(escapes) >= 40) & matches(text, fixed.PY_DYN_EXEC) & (escaped / (size + 1) > 0.25)
    return found(text, low, fixed.PY_ESCAPED_EVAL) | (likely(low, fixed.ESCAPE_SEQUENCE) & dense)


def external_install_fetch(text: Column, low: Column) -> Column:
    """Host that an install script calls out to, or null: not a usual one, and ephemeral or told who asks."""
    leak = found(text, low, fixed.HOST_RECON)
    hosts = F.filter(all_matches(text, fixed.URL_HOST, 1, 60), lambda h: ~install_fetch_allowed(h) & (is_ephemeral_tunnel(h) | leak))
    return F.when(low.contains("http") & found(text, low, fixed.NET_PRIMITIVE), F.get(hosts, F.lit(0)))


def looks_obfuscated(text: Column, low: Column, size: Column, longest: Column) -> Column:
    return (size >= 2000) & (longest >= 1000) & found(text, low, fixed.EVAL_MARKER)


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; null for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity).cast("int") - 1


def severity_of(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), rank), F.lit("info"))


def npm_version_from_tarball(name: Column, file: Column) -> Column:
    stem = F.regexp_replace(file, r"\.tgz\z", "")
    prefix = F.concat(F.substring_index(name, "/", -1), F.lit("-"))
    return F.when(F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1)).otherwise(stem)


def split_npm_tarball(path: Column) -> Column:
    """Struct name, file of a registry path name/-/file; null if it is none."""
    at = F.locate("/-/", path)
    return F.when(at > 1, F.struct(F.substr(path, F.lit(1), at - 1).alias("name"), F.substr(path, at + 3).alias("file")))


def pypi_name_version(file: Column) -> Column:
    """Struct name, version of a wheel's or an sdist's file name."""
    wheel = F.split(F.regexp_replace(file, r"\.whl\z", ""), "-")
    stem = F.regexp_replace(file, r"\.tar\.gz\z", "")
    made = lambda n, v: F.struct(n.alias("name"), v.alias("version"))
    return (
        F.when(file.endswith(".whl"), made(wheel[0], F.coalesce(F.get(wheel, F.lit(1)), F.lit(""))))
        .when(file.endswith(".tar.gz") & stem.contains("-"), made(F.regexp_replace(stem, r"-[^-]*\z", ""), F.substring_index(stem, "-", -1)))
        .when(file.endswith(".tar.gz"), made(stem, F.lit("")))
        .otherwise(made(file, F.lit("")))
    )


def rewrite_prefix(old: str, new: str):
    """A pandas UDF that replaces a prefix in all strings of a JSON document. The document's shape is open, hence
    Python."""

    def walk(x):
        if isinstance(x, str):
            return new + x[len(old) :] if x.startswith(old) else x
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return x

    @F.pandas_udf(T.StringType())
    def rewrite(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else json.dumps(walk(json.loads(d)), ensure_ascii=False, separators=(",", ":")))

    return rewrite


def rewrite_file_urls(files: Column, old: str, new: str) -> Column:
    """files: array of structs with a url."""
    return F.transform(files, lambda f: f.withField("url", F.when(f["url"].startswith(old), F.concat(F.lit(new), F.substr(f["url"], F.lit(len(old) + 1)))).otherwise(f["url"])))


_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)


def _object_end(text: str, start: int) -> int | None:
    """Where the object that opens at start is closed. Braces in strings don't count, nor does what a backslash escapes."""
    depth, quoted = 0, False
    for mark in _MARKS.finditer(text, start):
        if mark.group() == '"':
            quoted = not quoted
        elif not quoted and mark.group() in "{}":
            depth += 1 if mark.group() == "{" else -1
            if not depth:
                return mark.end()
    return None


def last_object(text: str | None) -> str | None:
    """The last balanced top-level object in noisy output; a brace that is never closed opens none."""
    last, at = None, 0
    while text and (start := text.find("{", at)) >= 0:
        end = _object_end(text, start)
        last, at = (last, start + 1) if end is None else (text[start:end], end)
    return last


@F.pandas_udf(T.StringType())
def last_json_object(texts: pd.Series) -> pd.Series:
    """last_object of each text. A scanner, hence Python."""
    return texts.map(last_object)


MODEL_OUTPUT = "verdict string, confidence double, rationale string, signals array<string>"


def model_judgment(found: Column) -> Column:
    """Struct of a model's judgment, given its JSON object; null unless its verdict is one of the three."""
    out = F.from_json(found, MODEL_OUTPUT)
    return F.when(out["verdict"].isin("allow", "quarantine", "block"), out)


def parse_model_output(text: Column) -> Column:
    """The judgment in a model's output."""
    return model_judgment(last_json_object(text))


def advisory_severity(label: Column, scores: Column) -> Column:
    """The database's own label; without one high if any score is a CVSS one, else medium."""
    up = F.upper(F.coalesce(label, F.lit("")))
    scored = F.exists(F.coalesce(scores, F.array().cast("array<struct<type:string,score:string>>")), lambda s: F.upper(s["type"]).startswith("CVSS"))
    return F.when(up == "CRITICAL", "critical").when(up == "HIGH", "high").when(up.isin("MODERATE", "MEDIUM"), "medium").when(up == "LOW", "low").when(scored, "high").otherwise("medium")


def advisory_ecosystem(ecosystem: Column) -> Column:
    return F.when(ecosystem == "npm", "npm").when(ecosystem == "pypi", "PyPI")


def is_signed_envelope(document: Column) -> Column:
    return F.get_json_object(document, "$.signature").isNotNull()


def campaign_prefix(name: Column, tokens: int = 2) -> Column:
    """The first tokens of a hyphenated name that has more."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) > tokens, F.array_join(F.slice(parts, 1, tokens), "-"))


def clears(decision: Column) -> Column:
    return decision == "allow"


