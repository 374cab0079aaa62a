"""Surrogates: plausible values of the same type as pure expressions of (scope salt, canonical form, attempt)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.crypto import choice, hmac_hex, number
from . import written_dates
from .canonical import bound, environment, ipv4_number, ipv4_text, ipv6_groups, is_internal, is_private, is_service, subnet
from .overlap import class_of

SEPARATOR = "\x1f"
#: Scheme, host, port, path, query and fragment of a URL.
URL = r"\A([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(:[0-9]{1,5})?([^?#]*)(\?[^#]*)?(#.*)?\z"
#: Address and query of a mailto link.
MAILTO = r"(?i)\A(mailto:)([^?@]+)@([^?@]+)(\?.*)?\z"


class Generator:
    """Surrogate columns for one scope. salt: derived from the master key and the scope on the driver."""

    def __init__(self, salt: bytes):
        self.salt = salt

    def digest(self, *parts: Column | str) -> Column:
        columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
        return hmac_hex(self.salt, F.concat_ws(SEPARATOR, *columns))

    def attributes(self, kind: Column, canon: Column) -> Column:
        """array<struct<of, value>> of what an entity shares with others: its network, zone, organisation or registry; at most one."""
        attr = lambda k: F.coalesce(F.element_at(canon["attrs"], k), F.lit(""))
        v, of = canon["normalized"], canon["kind"]
        made = lambda name, value: F.struct(F.lit(name).alias("of"), F.lower(value).alias("value"))
        host = F.lower(F.regexp_extract(v, URL, 2))
        zone = F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, r"\A[^.]*\.", "")).otherwise("")
        network, six = subnet(ipv4_number(host)), ipv6_groups(F.regexp_replace(host, r"[\[\]]", ""))
        mailed = F.lower(F.regexp_extract(v, MAILTO, 3))
        first = F.substring_index(v, "/", 1)
        found = (
            F.when(of == "ip", F.when(attr("v") == "6", made("net6", attr("subnet"))).otherwise(made("net", attr("subnet"))))
            .when(of == "email", made("zone", attr("domain")))
            .when(of == "host", made("zone", attr("zone")))
            .when(of == "repo", made("org", attr("org")))
            .when((of == "image") & F.contains(first, F.lit(".")), made("registry", first))
            .when((kind == "URL") & F.contains(v, F.lit("://")), F.when(network.isNotNull(), made("net", network)).when(F.startswith(host, F.lit("[")) & six.isNotNull(), made("net6", F.array_join(F.slice(six, 1, 4), ":"))).otherwise(made("zone", zone)))
            .when((kind == "URL") & (mailed != ""), made("zone", mailed))
        )
        return F.filter(F.array(found), lambda x: x.isNotNull() & (x["value"] != ""))

    def shared(self, etype: Column, value: Column, attempt: Column) -> Column:
        """The surrogate that an attempt proposes for a shared attribute; whole numbers of attempts widen the space."""
        number_of = ipv4_number(value)
        d = number(self.digest("shared net", value, attempt))
        dec = lambda k: F.lit(k).cast("decimal(20,0)")
        block = lambda base, count: F.lit(base) + F.pmod(d, dec(count)).cast("bigint") * 256
        net = ipv4_text(F.when(is_private(number_of), block(0x0A000000, 1 << 16)).when(attempt < 4, block(0xC6120000, 512)).otherwise(block(0xF0000000, (1 << 20) - 256)))
        six = self.digest("shared net6", value, attempt)
        net6 = F.concat(F.lit("2001:db8:"), F.substring(six, 1, 4), F.lit(":"), F.substring(six, 5, 4))
        tail = F.when(attempt < 32, "").otherwise(F.concat(F.lit("-"), F.substring(self.digest("wide", value, attempt), 1, 10)))
        name = F.concat(self.words(fixed.ORG_WORDS, F.concat(etype, F.lit(":"), value), attempt, value), tail)
        return F.when(etype == "_net", net).when(etype == "_net6", net6).when(etype == "_zone", self.zone(value, is_internal(value), attempt)).when(etype == "_registry", F.concat(name, F.lit(".example"))).otherwise(name)

    def words(self, table: tuple[str, ...], key: Column, attempt: Column, avoid: Column) -> Column:
        """Two words of the table, drawn anew up to eight times until neither is in avoid; numbered from attempt 16 on."""
        def draw(i: Column) -> Column:
            d = self.digest("words", key, attempt, i)
            return F.array(choice(table, number(d)), choice(table, number(d, 8)))

        draws = F.transform(F.sequence(F.lit(0), F.lit(7)), draw)
        clear = F.filter(draws, lambda w: ~F.exists(w, lambda x: F.contains(F.lower(avoid), x)))
        pair = F.coalesce(F.get(clear, F.lit(0)), F.get(draws, F.lit(7)))
        digits = F.when(attempt < 24, F.lit(10**3)).otherwise(F.lit(10**9)).cast("decimal(20,0)")
        tail = F.when(attempt >= 16, F.concat(F.lit("-"), (F.pmod(number(self.digest("number", key, attempt)), digits) + 100).cast("string"))).otherwise("")
        return F.concat(F.array_join(pair, "-"), tail)

    def ipv4_in(self, value: Column, network: Column, attempt: Column) -> Column:
        """An address in the allocated network: the last byte is permuted, so addresses of a network stay apart."""
        n = ipv4_number(value)
        last = F.pmod(n, F.lit(256))
        odd = F.pmod(number(self.digest("odd", n - last)), F.lit(128).cast("decimal(20,0)")).cast("bigint") * 2 + 1
        add = F.pmod(number(self.digest("add", n - last)), F.lit(256).cast("decimal(20,0)")).cast("bigint")
        return ipv4_text(ipv4_number(network) + F.pmod(last * odd + add + attempt, F.lit(256)))

    def ipv6_in(self, value: Column, network: Column, attempt: Column) -> Column:
        """An address of the documentation range: the allocated network, then 64 bits of the value's own."""
        d = self.digest("ipv6", F.lower(value), attempt)
        return F.concat_ws(":", network, *(F.substring(d, 4 * i + 1, 4) for i in range(4)))

    def ipv4(self, value: Column, private: Column, attempt: Column) -> Column:
        """Without an allocated network. Members of one /24 stay together: the network depends on the network and attempt // 8, the host on the address."""
        n = ipv4_number(value)
        real_net = n - F.pmod(n, F.lit(256))
        d = number(self.digest("net", real_net, F.floor(attempt / 8)))
        dec = lambda k: F.lit(k).cast("decimal(20,0)")
        inside = F.lit(0x0A000000) + F.pmod(d, dec(65536)).cast("bigint") * 256
        outside = F.lit(0xC6120000) + F.pmod(d, dec(512)).cast("bigint") * 256
        net = F.when(private, inside).otherwise(outside)
        host = F.pmod(number(self.digest("host", n, attempt)), dec(254)).cast("bigint") + 1
        return ipv4_text(net + host)

    def zone(self, zone: Column, internal: Column, attempt: Column) -> Column:
        """A zone of fictional words: internal ones keep their suffix, others get a reserved top level."""
        suffix = F.coalesce(*(F.when(F.endswith(zone, F.lit(s[1:])), F.lit(s)) for s in sorted(fixed.INTERNAL_SUFFIXES, key=len, reverse=True)), F.lit(".internal"))
        name = self.words(fixed.ORG_WORDS, F.concat(F.lit("zone:"), zone), attempt, zone)
        top = F.concat(F.lit("."), choice(fixed.FICTIONAL_TLDS, number(self.digest("tld", zone))))
        return F.when(zone == "", "").otherwise(F.concat(name, F.when(internal, suffix).otherwise(top)))

    def host(self, value: Column, zone: Column, internal: Column, env: Column, attempt: Column, new_zone: Column | None = None) -> Column:
        short = F.substring_index(F.lower(value), ".", 1)
        digits = F.regexp_extract(short, r"[0-9]{1,4}", 0)
        name = F.concat_ws("-", self.words(fixed.SERVICE_WORDS, F.concat(F.lit("host:"), short), attempt, short), F.when(digits != "", digits), F.when(env != "", env))
        return F.when(zone == "", name).otherwise(F.concat(name, F.lit("."), self.zone(zone, internal, F.lit(0)) if new_zone is None else F.coalesce(new_zone, self.zone(zone, internal, F.lit(0)))))

    def email(self, local: Column, domain: Column, actor: Column, env: Column, internal: Column, attempt: Column, new_zone: Column | None = None) -> Column:
        d = self.digest("email", local, domain, attempt)
        first, last = choice(fixed.FIRST_NAMES, number(d)), F.concat(choice(fixed.LAST_PARTS, number(d, 8)), choice(fixed.LAST_PARTS, number(d, 16)))
        mark = F.regexp_extract(local, "[._-]", 0)
        tail = F.when(attempt >= 16, F.pmod(number(self.digest("tail", local, domain, attempt)), F.lit(10**9).cast("decimal(20,0)")).cast("string")).when(attempt >= 8, attempt.cast("string")).otherwise("")
        human = F.concat(first, mark, last, tail)
        service = F.concat_ws("-", F.lit("svc"), choice(fixed.SERVICE_WORDS, number(d)), F.concat(choice(fixed.ROLES, number(d, 8)), tail), F.when(env != "", env))
        return F.concat(F.when(actor == "service", service).otherwise(human), F.lit("@"), self.zone(domain, internal, F.lit(0)) if new_zone is None else F.coalesce(new_zone, self.zone(domain, internal, F.lit(0))))

    def hexadecimal(self, value: Column, attempt: Column) -> Column:
        """As many hex digits as the value has, in its case, behind the algorithm's name where it has one."""
        name = F.regexp_extract(value, r"\A[A-Za-z][A-Za-z0-9-]{1,15}:", 0)
        body = F.substring(value, F.length(name) + 1, F.length(value))
        more = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.ceil(F.length(body) / 64).cast("int"))), lambda i: self.digest("hex", F.lower(body), attempt, i))
        more = F.when(F.length(body) > 128, F.array_join(more, "")).otherwise("")
        out = F.substring(F.concat(self.digest("hex", F.lower(body), attempt), self.digest("hex2", F.lower(body), attempt), more), F.lit(1), F.length(body))
        return F.concat(name, F.when(body.rlike("[A-F]") & ~body.rlike("[a-f]"), F.upper(out)).otherwise(out))

    def uuid(self, value: Column, attempt: Column) -> Column:
        """Version and variant digits stay."""
        d = self.digest("uuid", F.lower(value), attempt)
        cut = lambda a, n: F.substring(d, a, n)
        return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.substring(value, 15, 1), cut(13, 3)), F.concat(F.substring(value, 20, 1), cut(16, 3)), cut(19, 12))

    def mac(self, value: Column, attempt: Column) -> Column:
        """A locally administered unicast address in the value's notation."""
        d = self.digest("mac", F.regexp_replace(F.lower(value), "[^0-9a-f]", ""), attempt)
        digits = F.concat(F.lit("02"), F.substring(d, 1, 10))
        mark = F.regexp_extract(value, "[:.-]", 0)
        size = F.when(mark == ".", 4).otherwise(2)
        pairs = F.when(mark == "", F.array(digits)).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.lit(12) / size).cast("int") - 1), lambda i: F.substring(digits, i * size + 1, size)))
        return F.replace(F.array_join(pairs, "|"), F.lit("|"), mark)

    def phone(self, value: Column, attempt: Column) -> Column:
        """The layout and the country code stay. The number lies in a range that its country sets aside for fiction, or, where
        there is none or after 12 attempts, starts with a zero, with which no national number starts."""
        codes = sorted(fixed.FICTION_NUMBERS, key=len, reverse=True)

        def parts(digits: Column) -> Column:
            code = F.when(F.startswith(value, F.lit("+")), F.coalesce(*(F.when(F.startswith(digits, F.lit(c)), F.lit(c)) for c in codes), F.regexp_extract(value, r"\A\+([0-9]{1,3})(?=[^0-9])", 1))).otherwise("")
            d = self.digest("phone", F.regexp_replace(value, "[^0-9+]", ""), attempt)
            return F.struct(digits.alias("digits"), code.alias("code"), d.alias("d"))

        def headed(p: Column) -> Column:
            d, size = p["d"], F.length(p["digits"]) - F.length(p["code"])
            # 15 hex digits make 18 decimal ones at most; padded in front, so that all places vary.
            drawn = lambda at: F.reverse(F.lpad(F.conv(F.substring(d, at, 15), 16, 10), 18, "0"))
            body = F.concat(drawn(1), drawn(17))
            # Numbers without a country code of ten digits are North American; their area code is drawn as well.
            head = F.coalesce(*(F.when((p["code"] == c) if c != "1" else ((p["code"] == c) | ((p["code"] == "") & (size == 10))), choice(fixed.FICTION_NUMBERS[c], number(d, 8))) for c in codes), F.lit("0"))
            area = F.concat((F.pmod(number(d, 2), F.lit(8).cast("decimal(20,0)")) + 2).cast("string"), F.substring(body, 20, 2))
            head = F.when(attempt >= 12, F.lit("0")).otherwise(F.replace(head, F.lit("NXX"), area))
            return F.concat(p["code"], F.substring(F.concat(head, body), F.lit(1), size))

        def laid_out(new: Column) -> Column:
            state = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
            step = lambda s, c: F.struct((s["i"] + c.rlike("[0-9]").cast("int")).alias("i"), F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(new, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))
            return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), state, step, lambda s: s["out"])

        return bound(bound(bound(F.regexp_replace(value, "[^0-9]", ""), parts), headed), laid_out)

    def person(self, value: Column, attempt: Column) -> Column:
        d = self.digest("person", F.lower(value), attempt)
        words = F.size(F.split(F.trim(value), r"\s+"))
        more = F.when(attempt >= 16, F.concat(*(choice(fixed.LAST_PARTS, number(self.digest("person more", F.lower(value), attempt), 8 * i)) for i in range(3)))).when(attempt >= 2, choice(fixed.LAST_PARTS, number(d, 20))).otherwise("")
        last = F.initcap(F.concat(choice(fixed.LAST_PARTS, number(d, 8)), choice(fixed.LAST_PARTS, number(d, 16)), more))
        return F.when(words <= 1, last).otherwise(F.concat_ws(" ", F.array_repeat(F.initcap(choice(fixed.FIRST_NAMES, number(d))), 1), F.array_repeat(F.initcap(choice(fixed.FIRST_NAMES, number(d, 24))), F.greatest(words - 2, F.lit(0))), last))

    def iban(self, value: Column, attempt: Column) -> Column:
        """The country, the length and the layout stay; the bank is 0 and the check digits are right (ISO 13616)."""
        flat = F.upper(F.regexp_replace(value, r"\s", ""))
        country, size = F.substring(flat, 1, 2), F.length(flat)
        digits = F.regexp_replace(F.concat(F.conv(F.substring(self.digest("iban", flat, attempt), 1, 15), 16, 10), F.conv(F.substring(self.digest("iban", flat, attempt), 17, 15), 16, 10), F.lit("0" * 10)), "[^0-9]", "")
        body = F.substring(F.concat(F.lit("00000"), digits), F.lit(1), size - 4)
        check = F.lit(98) - mod97(F.concat(body, country, F.lit("00")))
        new = F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)
        state = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
        return F.aggregate(F.split(value, ""), state, lambda s, c: F.struct((s["i"] + (~c.rlike(r"\s")).cast("int")).alias("i"), F.concat(s["out"], F.when(c.rlike(r"\s"), c).otherwise(F.substring(new, s["i"] + 1, F.lit(1)))).alias("out")), lambda s: s["out"])

    def repo(self, value: Column, org: Column, name: Column, attempt: Column, shared: Column | None = None) -> Column:
        """The forge, the scheme and .git stay; organisations map alike everywhere."""
        new_org = F.coalesce(shared if shared is not None else F.lit(None), self.words(fixed.ORG_WORDS, F.concat(F.lit("org:"), org), F.lit(0), org))
        new_name = F.concat_ws("-", self.words(fixed.SERVICE_WORDS, F.concat_ws("/", F.lit("repo:"), org, name), attempt, name), choice(fixed.ROLES, number(self.digest("role", org, name))))
        path = F.concat(new_org, F.lit("/"), new_name)
        head = F.regexp_extract(value, r"(?i)\A((?:[a-z+]+://)?(?:[^@/]*@)?[a-z0-9.-]+(?::[0-9]+)?[:/]+)[^/]+/+[^/]+", 1)
        return F.when(head != "", F.concat(head, path, F.regexp_extract(value, r"\.git/?\z", 0))).otherwise(path)

    def image(self, value: Column, attempt: Column, shared: Column | None = None) -> Column:
        """registry/path:tag: the registry is shared, each path segment has its words, the tag stays."""
        tag = F.regexp_extract(value, r"(?::[A-Za-z0-9._-]+)?\z", 0)
        parts = F.split(F.substring(value, F.lit(1), F.length(value) - F.length(tag)), "/")
        registry = F.coalesce(shared if shared is not None else F.lit(None), F.concat(self.words(fixed.ORG_WORDS, F.concat(F.lit("registry:"), F.lower(parts[0])), F.lit(0), parts[0]), F.lit(".example")))
        named = F.when(F.contains(parts[0], F.lit(".")), registry).otherwise(self.words(fixed.SERVICE_WORDS, F.concat(F.lit("segment:"), F.lower(parts[0])), attempt, parts[0]))
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: self.words(fixed.SERVICE_WORDS, F.concat(F.lit("segment:"), F.lower(p)), attempt, p))
        return F.concat(F.array_join(F.concat(F.array(named), rest), "/"), tag)

    def url(self, value: Column, attempt: Column, shared: Column | None = None) -> Column:
        """Scheme, port, plain query names and the number of path segments and parameters stay; the host is what it is as a host or an
        address of either family, all else is masked."""
        at = lambda i: F.regexp_extract(value, URL, i)
        host = F.lower(at(2))
        zone = F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, r"\A[^.]*\.", "")).otherwise("")
        address = self.ipv4(host, F.lit(False), attempt) if shared is None else F.coalesce(self.ipv4_in(host, shared, attempt), self.ipv4(host, F.lit(False), attempt))
        six = self.ipv6_in(host, F.coalesce(shared if shared is not None else F.lit(None).cast("string"), F.lit("2001:db8:0:0")), attempt)
        new_host = F.when(ipv4_number(host).isNotNull(), address).when(F.startswith(host, F.lit("[")), F.concat(F.lit("["), six, F.lit("]"))).otherwise(self.host(host, zone, is_internal(host), environment(host), attempt, shared))
        mask = lambda x: F.concat(F.lit("x"), F.substring(self.digest("segment", x), 1, 8))
        path = F.array_join(F.transform(F.split(at(4), "/"), lambda p: F.array_join(F.transform(F.split(p, ";"), lambda x, i: F.when(i == 0, F.when(x.isin("", "api", "v1", "v2", "index.html"), x).otherwise(mask(x))).otherwise(self.named(x, mask))), ";")), "/")
        query = F.array_join(F.transform(F.split(F.regexp_replace(at(5), r"\A\?", ""), "&"), lambda p: self.named(p, mask)), "&")
        return F.concat(at(1), new_host, at(3), path, F.when(at(5) != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(at(6) != "", F.concat(F.lit("#"), mask(at(6)))).otherwise(""))

    @staticmethod
    def named(pair: Column, mask) -> Column:
        """name=value with its value masked, and its name too unless it is a plain word."""
        name, rest = F.substring_index(pair, "=", 1), F.regexp_replace(pair, r"\A[^=]*=", "")
        return F.when(~F.contains(pair, F.lit("=")), F.when(pair == "", pair).otherwise(mask(pair))).otherwise(F.concat(F.when(name.rlike(r"\A[A-Za-z][A-Za-z_-]{0,30}\z"), name).otherwise(mask(name)), F.lit("="), F.when(rest == "", rest).otherwise(mask(rest))))

    def mailto(self, value: Column, attempt: Column, shared: Column | None = None) -> Column:
        """The address becomes what it is as one in the same round; query values are masked."""
        at = lambda i: F.regexp_extract(value, MAILTO, i)
        local, domain = F.lower(at(2)), F.lower(at(3))
        mask = lambda x: F.concat(F.lit("x"), F.substring(self.digest("segment", x), 1, 8))
        address = self.email(local, domain, F.when(is_service(local), "service").otherwise("human"), environment(local), is_internal(domain), attempt, shared)
        query = F.array_join(F.transform(F.split(F.regexp_replace(at(4), r"\A\?", ""), "&"), lambda p: self.named(p, mask)), "&")
        return F.concat(at(1), address, F.when(at(4) != "", F.concat(F.lit("?"), query)).otherwise(""))

    def date(self, value: Column, attempt: Column) -> Column:
        """One shift of 200 to 1199 days for the whole scope, so intervals stay; wraps within years 1 to 9999."""
        shift = F.pmod(number(self.digest("date")), F.lit(1000).cast("decimal(20,0)")).cast("int") + 200 + attempt
        return F.coalesce(written_dates.moved(value, shift), shifted_iso(value, shift))

    def cidr(self, value: Column, private: Column, attempt: Column) -> Column:
        """A network of the same size: in 10/8 or 198.18/15 where it fits in, else in the reserved range 240/4."""
        bits = F.regexp_extract(value, r"/([0-9]{1,2})\z", 1).try_cast("int")
        d = self.digest("cidr", value, attempt)
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - bits)
        place = lambda base, length: F.lit(base) + F.pmod(number(d), F.greatest(F.lit(1), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - length)).cast("decimal(20,0)")).cast("bigint") * size
        base = F.when(private & (bits >= 8) & (attempt < 16), place(0x0A000000, 8)).when(~private & (bits >= 15) & (attempt < 4), place(0xC6120000, 15)).when(bits >= 4, place(0xF0000000, 4)).otherwise(F.lit(0xF0000000))
        return F.concat(ipv4_text(base), F.lit("/"), bits.cast("string"))

    def path(self, value: Column, attempt: Column) -> Column:
        """Separators, public directories, dots in front and endings that tell only a format stay; every other part has words of its own,
        the same ones wherever the part stands."""
        mark = F.when(F.contains(value, F.lit("\\")), "\\").otherwise("/")

        def part(p: Column) -> Column:
            dot, rest = F.regexp_extract(p, r"\A\.*", 0), F.regexp_replace(p, r"\A\.*", "")
            ending = F.regexp_extract(rest, rf"(?i)(?:\.(?:{'|'.join(fixed.PUBLIC_EXTENSIONS)}))+\z", 0)
            stem = F.substring(rest, F.lit(1), F.length(rest) - F.length(ending))
            return F.when((rest == "") | p.isin(*fixed.PUBLIC_DIRECTORIES) | (p == "~") | (stem == ""), p).otherwise(F.concat(dot, self.words(fixed.SERVICE_WORDS, F.concat(F.lit("path:"), stem), attempt, stem), ending))

        return F.replace(F.array_join(F.transform(F.split(value, r"[/\\]"), part), "\x1e"), F.lit("\x1e"), mark)

    def address(self, value: Column, attempt: Column) -> Column:
        """A postal address: its digits and its way stay in shape, names of ways and places become words."""
        keep = "|".join((*fixed.WAYS_BEFORE, *fixed.WAYS_AFTER, *fixed.WAYS_JOINED, "de", "la", "le", "du", "des", "d", "l", "of", "the", "bis", "ter"))

        def piece(p: Column) -> Column:
            d = self.digest("address", F.lower(p), attempt)
            digits = F.concat(F.element_at(F.array(*map(F.lit, "123456789")), (F.pmod(number(d), F.lit(9).cast("decimal(20,0)")) + 1).cast("int")), F.reverse(F.lpad(F.conv(F.substring(d, 17, 15), 16, 10), 18, "0")))
            name = F.concat(choice(fixed.LAST_PARTS, number(d)), choice(fixed.LAST_PARTS, number(d, 8)))
            name = F.when(p.rlike(r"\A\p{Lu}"), F.initcap(name)).otherwise(name)
            joined = F.regexp_extract(p, rf"(?i)(?:{'|'.join(fixed.WAYS_JOINED)})\z", 0)
            return F.when(p.rlike(r"\A[0-9]+\z"), F.substring(digits, F.lit(1), F.length(p))).when(~p.rlike(r"\A[\p{L}]") | p.rlike(rf"(?i)\A(?:{keep})\z"), p).otherwise(F.concat(name, joined))

        pieces = F.regexp_extract_all(value, F.lit(r"[0-9]+|\p{L}+|[^0-9\p{L}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, piece), "")

    def organisation(self, value: Column, attempt: Column) -> Column:
        """Two words in capitals, with the legal form that the value ends in."""
        form = F.regexp_extract(value, r"(?i)[\s,]+(?:inc|ltd|llc|plc|gmbh|ag|sa|sas|sarl|s\.a\.|bv|nv|spa|srl|co)\.?\z", 0)
        name = self.words(fixed.ORG_WORDS, F.concat(F.lit("organisation:"), F.lower(value)), attempt, value)
        return F.concat(F.initcap(F.replace(name, F.lit("-"), F.lit(" "))), form)

    def generic(self, kind: Column, value: Column, env: Column, attempt: Column) -> Column:
        prefix = F.regexp_extract(value, r"\A(?:svc-|sa-|srv-|bot-|ci-|ns-|app-)", 0)
        digits = F.regexp_extract(F.substring(value, F.length(prefix) + 1, F.lit(3)), r"\A[0-9]{1,3}", 0)
        name = self.words(fixed.SERVICE_WORDS, F.concat_ws(":", F.lower(kind), F.lower(value)), attempt, value)
        return F.concat(prefix, F.concat_ws("-", name, F.when(digits != "", digits), F.when(env != "", env)))

    def secret(self, kind: Column, value: Column) -> Column:
        """A one-way reference: never stored, never restored. Formats stay recognisable."""
        d = self.digest("secret", kind, value)
        token = F.regexp_extract(value, r"\A(?:gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk-|AKIA|ASIA|dop_v1_|npm_)", 0)
        label = F.regexp_extract(value, r"(?s)\A([^:=]*[:=]\s*[\"']?)", 1)
        armour = F.regexp_extract(value, r"-----BEGIN ([A-Z0-9 ]+)-----", 1)
        size = F.least(F.greatest(F.length(value), F.lit(16)), F.lit(48))
        body = F.substring(d, F.lit(1), size)
        return (
            F.when(kind == "JWT", F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(d, 1, 12)), F.substring(d, 13, 24), F.substring(d, 37, 24)))
            .when(armour != "", F.concat(F.lit("-----BEGIN "), armour, F.lit("-----\n"), d, F.lit("\n-----END "), armour, F.lit("-----")))
            .when(token != "", F.concat(token, F.substring(d, 1, 32)))
            .when((kind == "PASSWORD_CONTEXT") & (label != ""), F.concat(label, F.substring(d, 1, 24), F.regexp_extract(value, r"[\"']\z", 0)))
            .otherwise(body)
        )

    def candidate(self, kind: Column, value: Column, canon: Column, attempt: Column, shared: Column | None = None, present: set[tuple[str, str]] | None = None) -> Column:
        """The surrogate that the given attempt proposes for a value that is no secret; shared: that of its attribute, see attributes().

        present: pairs of canonical kind and type that occur at all, where that is known; it keeps the expression small.
        """
        attr = lambda k: F.coalesce(F.element_at(canon["attrs"], k), F.lit(""))
        of = canon["kind"]
        v = canon["normalized"]

        def address() -> Column:
            four = self.ipv4(v, attr("private") == "true", attempt)
            if shared is None:
                return four
            return F.when(attr("v") == "6", self.ipv6_in(v, shared, attempt)).otherwise(F.coalesce(self.ipv4_in(v, shared, attempt), four))

        by_form = {
            "ip": address,
            "email": lambda: self.email(attr("local"), attr("domain"), attr("actor"), attr("env"), is_internal(attr("domain")), attempt, shared),
            "repo": lambda: self.repo(v, attr("org"), attr("name"), attempt, shared),
            "host": lambda: self.host(v, attr("zone"), attr("internal") == "true", attr("env"), attempt, shared),
            "image": lambda: self.image(v, attempt, shared),
            "date": lambda: self.date(v, attempt),
            "cidr": lambda: self.cidr(v, attr("private") == "true", attempt),
        }
        by_type = [
            (("FILE_PATH", "USER_PATH"), lambda: self.path(v, attempt)),
            (("ADDRESS", "STREET_ADDRESS", "LOCATION"), lambda: self.address(v, attempt)),
            (("ORGANIZATION",), lambda: self.organisation(v, attempt)),
            (("COMMIT_SHA", "HASH", "CERT_THUMBPRINT", "CERT_SERIAL"), lambda: self.hexadecimal(v, attempt)),
            (("UUID",), lambda: self.uuid(v, attempt)),
            (("MAC_ADDRESS",), lambda: self.mac(v, attempt)),
            (("PHONE_NUMBER",), lambda: self.phone(v, attempt)),
            (("PERSON",), lambda: self.person(v, attempt)),
            (("IBAN_CODE",), lambda: self.iban(v, attempt)),
        ]
        forms, types = ({x for x, _ in present}, {x for _, x in present}) if present is not None else (None, None)
        branches = [(of == name, make) for name, make in by_form.items() if forms is None or name in forms]
        branches += [(kind.isin(*names), make) for names, make in by_type if types is None or types & set(names)]
        if types is None or "URL" in types:
            branches.append(((kind == "URL") & F.contains(v, F.lit("://")), lambda: self.url(v, attempt, shared)))
            branches.append(((kind == "URL") & v.rlike(MAILTO), lambda: self.mailto(v, attempt, shared)))
        out = None
        for condition, make in branches:
            out = F.when(condition, make()) if out is None else out.when(condition, make())
        rest = self.generic(kind, v, attr("env"), attempt)
        return rest if out is None else out.otherwise(rest)


def is_secret(kind: Column) -> Column:
    return class_of(kind) == "secret"


def mod97(text: Column) -> Column:
    """The remainder of an account number, letters as 10 to 35, by 97."""
    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(s * F.when(value(c) >= 10, 100).otherwise(10) + value(c), F.lit(97)))


#: Days of the years 1 to 9999.
DAYS = 3_652_059


def shifted_iso(value: Column, days: Column) -> Column:
    """An ISO date with what follows it, moved by days within years 1 to 9999; other values unchanged."""
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    first = F.lit("0001-01-01").cast("date")
    moved = F.date_add(first, F.pmod(F.datediff(day, first) + days, F.lit(DAYS)).cast("int"))
    return F.when(day.isNotNull(), F.concat(F.date_format(moved, "yyyy-MM-dd"), F.substring(value, 11, 1 << 30))).otherwise(value)
