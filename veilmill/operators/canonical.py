"""Entity resolution: values of a type become canonical keys, with the attributes that surrogates keep."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import ENVIRONMENT_ALIAS, ENVIRONMENTS, FORGES, INTERNAL_SUFFIXES, SERVICE_PREFIXES, SERVICE_SUFFIXES

_ENV = rf"(?i)(?<![a-z0-9])({'|'.join(ENVIRONMENTS)})(?![a-z0-9])"


def environment(value: Column) -> Column:
    """prod, staging, dev, ... of the first word that names an environment; empty if none does."""
    found = F.lower(F.regexp_extract(value, _ENV, 1))
    alias = F.create_map(*(F.lit(x) for pair in ENVIRONMENT_ALIAS.items() for x in pair))
    return F.coalesce(F.element_at(alias, found), found)


def is_internal(host: Column) -> Column:
    return F.rtrim(F.lower(host), F.lit(".")).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in INTERNAL_SUFFIXES) + r")\z")


def is_service(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(rf"\A(?:{'|'.join(SERVICE_PREFIXES)})") | low.rlike(rf"(?:{'|'.join(SERVICE_SUFFIXES)})\z")


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a whole number; null for anything else."""
    parts = F.transform(F.split(value, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    return F.when(value.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z") & F.forall(parts, lambda x: x <= 255), number)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.pmod(F.shiftright(number, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))


def bound(value: Column, result) -> Column:
    """result(value) with the value computed once, wherever and however often the result has it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def ipv6_groups(value: Column) -> Column:
    """The eight groups of an IPv6 address, four lower-case hex digits each; null for anything else. A zone behind % is dropped."""
    side = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def sides(low: Column) -> Column:
        cut = F.contains(low, F.lit("::"))
        right = F.when(cut, side(F.regexp_replace(low, r"\A.*::", ""))).otherwise(F.array().cast("array<string>"))
        return F.struct(low.alias("low"), cut.alias("cut"), side(F.substring_index(low, "::", 1)).alias("left"), right.alias("right"))

    def groups(s: Column) -> Column:
        missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
        fine = ~s["low"].rlike(r":::|::.*::|\A:[^:]|[^:]:\z|[0-9a-f]{5}") & F.when(s["cut"], missing > 0).otherwise(missing == 0)
        return F.when(fine, F.transform(F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"]), lambda g: F.lpad(g, 4, "0")))

    found = bound(bound(F.lower(F.regexp_replace(value, r"%[^%]*\z", "")), sides), groups)
    return F.when(value.rlike(r"(?i)\A[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:]*(?:%.*)?\z"), found)


def network(value: Column) -> Column:
    """struct<base, bits> of an IPv4 network in CIDR notation, its host bits cleared; null for anything else."""

    def cleared(n: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - n["bits"])
        return F.when(n["base"].isNotNull() & n["bits"].between(0, 32), F.struct((n["base"] - F.pmod(n["base"], size)).alias("base"), n["bits"].alias("bits")))

    parts = F.struct(ipv4_number(F.substring_index(value, "/", 1)).alias("base"), F.regexp_extract(value, r"/([0-9]{1,2})\z", 1).try_cast("int").alias("bits"))
    return F.when(value.rlike(r"\A[0-9.]+/[0-9]{1,2}\z"), bound(parts, cleared))


def nfc(value: Column) -> Column:
    """Unicode normalisation, composed: a pandas UDF over what isn't ASCII; ASCII is its own."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t)).astype(object)

    plain = value.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, value).otherwise(composed(F.when(~plain, value)))


#: Address ranges that are private without being set aside for documentation or benchmarks: first and last number.
PRIVATE_RANGES = tuple((int(a, 16), int(b, 16)) for a, b in (("00000000", "00FFFFFF"), ("0A000000", "0AFFFFFF"), ("7F000000", "7FFFFFFF"), ("A9FE0000", "A9FEFFFF"), ("AC100000", "AC1FFFFF"), ("C0A80000", "C0A8FFFF"), ("F0000000", "FFFFFFFF")))


def is_private(number: Column) -> Column:
    out = F.lit(False)
    for low, high in PRIVATE_RANGES:
        out = out | number.between(low, high)
    return out


def subnet(number: Column) -> Column:
    return ipv4_text(number - F.pmod(number, F.lit(256)))


def without_userinfo(url: Column) -> Column:
    """A URL without user:password@, in its usual and its scp form; mailto, data, tel, urn and sms have none."""
    plain = F.regexp_replace(url, r"\A([^:/?#]+://)[^/]*@", "$1")
    scp = F.regexp_replace(url, r"\A[^/?#]+@(?=[^@]*\z)", "")
    return F.when(F.contains(url, F.lit("://")), plain).when(url.rlike(r"(?i)\A(?:mailto|data|tel|urn|sms):"), url).otherwise(scp)


def repository(value: Column, short_form: Column) -> Column:
    """org/name of a repository in HTTPS, SSH, scp or (where short_form) org/name form; null for others."""
    forges = "|".join(f.replace(".", r"\.") for f in FORGES)
    pattern = rf"(?i)\A(?:[a-z+]+://)?(?:[^@/]*@)?(?:[a-z0-9-]+\.)*(?:{forges})(?::[0-9]+(?=/)|(?=[:/]))[:/]/*([^/?#]+)/+([^/?#]+)"
    org, name = F.lower(F.regexp_extract(value, pattern, 1)), F.lower(F.regexp_extract(value, pattern, 2))
    name = F.regexp_replace(name, r"\.git\z", "")
    short = F.when(short_form & value.rlike(r"\A[A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*\z"), F.lower(value))
    return F.when(org != "", F.concat_ws("/", org, name)).otherwise(short)


def written_day(value: Column) -> Column:
    """The day of a date that is written with a month's name or with numbers; null for others."""
    from .written_dates import reading

    return reading(value)["day"]


def canonical(kind: Column, value: Column) -> Column:
    """struct<key, kind, attrs map, normalized>. Values are taken as normalised text already; see nfc()."""
    v = F.trim(value)
    v = F.when(kind.isin("URL", "REPO"), without_userinfo(v)).otherwise(v)
    slashes = F.length(v) - F.length(F.replace(v, F.lit("/"), F.lit("")))
    v = F.when(kind.isin("URL", "REPO") & F.endswith(v, F.lit("/")) & slashes.isin(1, 3), F.regexp_replace(v, r"/\z", "")).otherwise(v)

    def derived(v: Column) -> Column:
        low = F.lower(v)
        bare = ~F.contains(v, F.lit("://")) & F.contains(v, F.lit(".")) & ~v.rlike(r"[/?#@ \t]")
        address = kind.isin("IP_ADDRESS", "CIDR")
        is_host = kind.isin("HOSTNAME", "FQDN", "CERT_CN", "HEX_HOSTNAME") | ((kind == "URL") & bare)
        return F.struct(
            v.alias("v"), low.alias("low"), F.when(address, ipv4_number(v)).alias("number"), F.when(address, ipv6_groups(v)).alias("six"), F.when(address, network(v)).alias("block"),
            F.when(kind == "DATE", written_day(v)).alias("day"), F.rtrim(low, F.lit(".")).alias("host"), F.when(kind.isin("URL", "REPO"), repository(v, kind == "REPO")).alias("repo"), is_host.alias("is_host"), environment(low).alias("env"),
        )

    def made(d: Column, key: Column, of: str, **attrs: Column) -> Column:
        pairs = [x for k, c in attrs.items() for x in (F.lit(k), c.cast("string"))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return F.struct(key.alias("key"), F.lit(of).alias("kind"), table.alias("attrs"), d["v"].alias("normalized"))

    def form(d: Column) -> Column:
        v, low, number, six, block, host, repo = (d[c] for c in ("v", "low", "number", "six", "block", "host", "repo"))
        short, zone = F.substring_index(host, ".", 1), F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, r"\A[^.]*\.", "")).otherwise("")
        local, domain = F.substring_index(low, "@", 1), F.regexp_replace(low, r"\A[^@]*@", "")
        of_host = lambda env: F.when(env != "", env).otherwise(environment(zone))
        private6 = F.array_join(six, "").rlike(r"\A(?:f[cd]|fe[89ab]|0{31}1\z)")
        return (
            F.when((kind == "DATE") & F.try_to_date(v, "yyyy-MM-dd").isNotNull(), made(d, v, "date"))
            .when(d["day"].isNotNull(), made(d, F.concat(F.lit("date:"), d["day"].cast("string"), F.lit("|"), low), "date"))
            .when((kind == "IP_ADDRESS") & number.isNotNull(), made(d, F.concat(F.lit("ip:"), ipv4_text(number)), "ip", subnet=subnet(number), private=is_private(number), v=F.lit("4")))
            .when((kind == "IP_ADDRESS") & six.isNotNull(), made(d, F.concat(F.lit("ip:"), F.array_join(six, ":")), "ip", subnet=F.array_join(F.slice(six, 1, 4), ":"), private=private6, v=F.lit("6")))
            .when(block.isNotNull(), made(d, F.concat(F.lit("cidr:"), ipv4_text(block["base"]), F.lit("/"), block["bits"].cast("string")), "cidr", bits=block["bits"], private=is_private(block["base"])))
            .when((kind == "EMAIL_ADDRESS") & F.contains(v, F.lit("@")), made(d, F.concat(F.lit("email:"), low), "email", actor=F.when(is_service(local), "service").otherwise("human"), domain=domain, local=local, env=environment(local)))
            .when(repo.isNotNull(), made(d, F.concat(F.lit("repo:"), repo), "repo", org=F.substring_index(repo, "/", 1), name=F.substring_index(repo, "/", -1), env=environment(repo)))
            .when(d["is_host"], made(d, F.concat(F.lit("host:"), short), "host", zone=zone, internal=is_internal(host), env=bound(environment(short), of_host)))
            .when(kind == "CONTAINER_IMAGE", made(d, F.concat(F.lit("image:"), low), "image", env=d["env"]))
            .otherwise(made(d, F.concat(F.lower(kind), F.lit(":"), low), "generic", env=d["env"], actor=F.when(is_service(low), "service").otherwise("")))
        )

    return bound(bound(v, derived), form)
