"""Secret scans: candidates by shape or by name, false positives removed by a random forest.

A candidate by shape is a maximal run of at least ``SHORTEST`` of the characters A-Z a-z 0-9 + / = _ - . with
or without a digit.  A candidate by name is what is assigned to, quoted after or said of a name like password,
token or key, or stands for the password in a URL: at least ``NAMED`` printable characters of any kind, up to
the closing quote, or else to white space.  The forest looks at its length, the transitions between its
characters, how much of it words of a dictionary cover, the path (the column ``source``) and the words beside
it, and was trained on labelled findings: secrets and look-alikes (digests, identifiers, card and phone numbers,
versions, paths, file names, placeholders, dates, expressions of code, labels, prose), in the ways they are
written in code, configuration and prose.  The findings are made here by ``labelled_findings``, since no table
holds any; train() takes a table of others.  Secrets that overlap are one finding, from the first to the last
byte of them.

Cost at scale: one scan, no shuffle.  Runs are found in numpy over Arrow buffers, texts with such a name by
Arrow's regular expressions; only those texts and candidates are looked at one by one.

Defined results.  Null or empty texts have no findings.  A secret that stands twice is found twice; rows that
repeat are scanned each.  ``first`` and ``size`` are in bytes of the UTF-8 text, so very long texts need
no special case.  A null source counts as an empty path.  Empty table: empty result.  redact() changes the
column text, and n_chars where there is one; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textbytes as tb
from graphloom.llm import trees

SHORTEST, NAMED, LEAST, BESIDE, MARK = 16, 6, 0.5, 64, b"[SECRET]"

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CLASS = np.full(256, 3, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2

COMMON = """anchor apple arrow autumn banana battery beach bicycle bird blanket blossom breeze bright candle canyon carpet castle cherry chicken cinnamon copper correct cowboy crystal dolphin dragon eagle elephant emerald feather flower forest garden ginger glacier guitar hammer harvest honey horse hunter island jacket jungle kitchen ladder lantern lemon letmein lion magic maple marble meadow monkey moonlight morning mountain mustang nickel ocean olive orange orchid panda paper parrot pebble pepper pirate pizza planet potato princess pumpkin purple puzzle quartz rabbit raven ribbon river rocket saddle sailor shadow silver spider staple starlight summer sunshine superman thunder tiger timber tomato troubador tulip turtle umbrella velvet violin walnut warrior willow winter wizard wombat yellow zebra""".split()
DICTIONARY = """about access account action active address admin after agent alpha android api app apple archive array asset async author backup banner base basic batch beta bin block board body book boot border bottom box branch break bridge browser buffer build bundle button cache call camera card cart case cast catalog category cell center central chain change channel char chart check child chunk city class clean client clock close cloud cluster code color column com command comment commit common component config connect console const contact container content context control cookie core count country course cover create credit current custom cycle daily dark data database date day debug default delete deploy description design desktop detail dev device diff direct disk display docker document docs domain double down download draft drive driver dummy edge edit editor element email empty enable end engine entry env error event example exit export extra fail feature field file filter final find first fixture flag float folder font footer foo format forward frame free front full function game gateway general get global graph grid group guide half handle hash head header health height help hidden history home host house html http https icon image img import index info init inner input insert install int internal item job join json kernel key kind lab label lang large last latest launch layer layout left lib library license light limit line link linux list load local lock log login long loop lower machine main make manager map mark master match max media member memory menu merge message meta method min mobile mock mode model module monitor month mount move name native nav net network new next node none normal note null number object office offset old online open option order org origin other outer output over owner package page panel param parent parse part password patch path pattern payment phone photo pipe pixel place placeholder plan platform player plugin point policy pool port post power prefix press preview price print private process prod product profile program project prompt property provider proxy public push query queue quick random range rate raw read ready record redirect region register release remote remove render repo report request reset resource response rest result return right role root route row rule run sale sample save scale scene schema scope score screen script scroll search second section secure select server service session set setting shape share shell shop short show side sign signal simple single site size sleep small socket sort source space spec split sql stable stack stage standard start state static status step stop storage store stream string style sub success suite super support switch sync system table tag target task team temp template term test text theme thread time title toggle token tool top total track trace train transfer tree trigger type ubuntu unit update upload upper url use user util valid value var vendor version video view void volume wait web week width window word work worker write year your yaml zone""".split()
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: -len(w))))
_NAMES = r"token|secret|passw|pwd|passphrase|passcode|pass\b|passe\b|kennwort|contrase|clave\b|api.?key|access.?key|private.?key|auth|bearer|credential|signing|encrypt|webhook|license.?key|\bkeys?\b|_key|key\b|cookie|session"
_SECRET_WORD = re.compile(_NAMES)
_PASSWORD = re.compile(r"passw|pwd|passphrase|passcode|pass\b|passe\b|kennwort|contrase|clave\b|secret")
_QUOTED = rb"""\\(["'`])(?P<a>[^\n]+?)\\\1|(["'`])(?P<b>(?:\\[^\n]|(?!\3)[^\\\n])+)\3"""
_BARE = rb"""(?P<c>[^\s"'`<>](?:(?!</)\S)*)"""
_IS = rb"is|was|are|ist|war|lautet|est|es|era"
#: From the end of the name to the value: an assignment, a tag, a call or an attribute; or words, of which the last says so.
_CLOSE = rb"""(?:\\?["'`])?[\])]{0,2}"""
_VALUE = rb"(?:\s{0,40}(?:" + _QUOTED + rb""")|[ \t]{0,40}["'`]?""" + _BARE + rb")"
_ASSIGNED = re.compile(_CLOSE + rb"(?:\s{0,40}(?::=|=>|->|==?|!=|[:(,>])|[ \t]+(?:value|default|content)=)" + _VALUE)
_TYPED = re.compile(_CLOSE + rb"\s{0,40}::?[ \t]*[\w.\[\]<>|?]{1,40}[ \t]*=" + _VALUE)
_TAG = re.compile(rb">(?P<d>[^<\n]+)</")
_SAID = re.compile(rb"""["'`]?[ \t]+(?:(?:[^\s=:]{1,20}[ \t]+){0,5}?(?:""" + _IS + rb""")[ \t]+(?:(?:now|set|to)[ \t]+){0,2})?(?:""" + _QUOTED + rb"|" + _BARE + rb")", re.I)
_NEXT = re.compile(rb"""[ \t]+(?:""" + _QUOTED + rb"|" + _BARE + rb")")
_NAME = re.compile(rb"(?:" + _NAMES.encode() + rb")[\w.\x80-\xff-]*", re.I)
_URL = re.compile(rb"://[^\s/:@\"'<>]{0,256}:(?P<c>[^\s/\"'<>]+)@")
_INNER = re.compile(_QUOTED)
#: Where an unquoted value ends before white space: at a quote opened before the name, or before the next name=.
_ENDS = re.compile(rb"""["'`](?=[,;:)\]}>]|$)|[;,&](?=["'`]?[A-Za-z_][\w.-]*["'`]?[=:])""")
#: For Arrow: a text that doesn't match has no candidate by name.
_HAS_NAME = r"(?i)token|secret|pass|pwd|kennwort|contrase|clave|key|auth|bearer|credential|signing|encrypt|webhook|cookie|session|://"
_PLAIN_WORD = re.compile(r"\b(?:sha\d*|commit|md5|checksum|digest|integrity|uuid|guid|etag|hash|revision|rev|build|version|image|file|path|url|href|src|isbn|phone|tel|card|iban|order|invoice|ticket|tracking|id|ref|example|sample|placeholder|dummy|date|timestamp|blob|tree|parent|merge|index|layer)\b")
_PATH_PLAIN = re.compile(r"test|spec|fixture|example|sample|mock|doc|readme|lock|vendor|dist|min\.|\.svg|\.md|changelog")
_PATH_SECRET = re.compile(r"\.env|config|secret|credential|deploy|settings|\.pem|\.tf|\.ya?ml|\.ini|\.properties")
_KNOWN = re.compile(r"AKIA[0-9A-Z]{12}|gh[pousr]_|xox[abpr]-|sk[_-](?:live|test|proj)?|AIza|eyJ[A-Za-z0-9_-]+\.|glpat-|npm_|pypi-|SG\.")
_SHAPES = [re.compile(x) for x in (r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"[\d.+-]+$", r"[0-9a-f]+$|[0-9A-F]+$", r"v?\d+(?:\.\d+)+", r"\d{4}-\d\d-\d\d", r"(?i)x{5}|your|change.?me|example|0123|1234|abcd|placeholder|dummy|test|(.)\1{4}")]
_CODE = re.compile(r"^[\$<{%(\[&@!*]+[\w{(\[]|[\w\])]\(|\(\)|[\])}]$|^[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+$|\[[\"'\w]+\]|\{\w*\}|^[A-Z]+(?:_[A-Z]+)+$")
_NOTHING = re.compile(r"^(?:none|null|true|false|undefined|nullptr|string|boolean|number|object|optional|required|default|empty|unknown|missing|invalid|function|return)\W*$|^(.)\1+$|redacted|\[secret|change.?(?:me|it)|your|enter|insert|placeholder|example|\.\.\.")


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    raw = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=4) / n
    count = np.bincount(raw)
    count = count[count > 0] / n
    low, before, path = value.lower(), before.lower(), path.lower()
    covered = sum(len(m) for m in _WORDS.findall(low)) / n
    step = np.abs(np.diff(raw.astype(np.int16)))
    name = re.search(r"([\w.-]+)\\?[\"']?[\])]{0,2}\s*(?::=|=>|->|[:=(,>])\s*\\?[\"'`]?$", before)
    near = before[-40:]
    letters = re.findall(r"[^\W\d_]+", low)
    vowels = sum(low.count(c) for c in "aeiouyäöüéèáíóú") / max(1, sum(map(len, letters)))
    return [
        math.log(n), *share, float(np.mean(kinds[1:] != kinds[:-1])) if n > 1 else 0.0, float(np.mean(step <= 1)) if n > 1 else 0.0, float(np.mean(step)) if n > 1 else 0.0,
        -float((count * np.log2(count)).sum()), len(count) / min(n, 64), covered, max((len(x) for x in re.split(r"[^A-Za-z]+", value)), default=0) / n, value.count("/") + value.count("."),
        value.count("-") + value.count("_"), float(n in (20, 24, 32, 36, 40, 43, 44, 64, 88, 128)), float(bool(_KNOWN.match(value))), *[float(bool(p.match(value) if k < 5 else p.search(value))) for k, p in enumerate(_SHAPES)],
        float(bool(name)), float(bool(name and _SECRET_WORD.search(name[1]))), float(bool(_SECRET_WORD.search(near))), float(bool(_PLAIN_WORD.search(near))), float(bool(re.search(r"[\"'`]$", before))),
        float(bool(re.match(r"[\"'`]", after))), float(bool(_PATH_PLAIN.search(path))), float(bool(_PATH_SECRET.search(path))),
        float(bool(_PASSWORD.search(name[1] if name else near))), value.count(" ") / n, float(len(letters)), vowels, max((len(x) for x in re.findall(r"[^\W\d_aeiouyäöüéèáíóú]+", low)), default=0) / n, float(np.count_nonzero(np.bincount(kinds, minlength=4))), float(value.isalpha()),
        float(value == low), float(bool(_SECRET_WORD.search(low))), float(bool(_CODE.search(value))), float(bool(_NOTHING.search(low))), float(bool(re.search(r"://[^\s/:@]*:$", before))), float(bool(re.search(r"bearer\s+$|basic\s+$", before))), float(low[:1].isalpha() and value[1:] == low[1:]),
    ]


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, 1 for a secret): as many secrets as look-alikes, in varied surroundings.

    A third each way have no shape of their own and are told by name and surroundings.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = lambda alphabet, k: "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), k)])
    hexa = lambda k: chars("0123456789abcdef", k)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment eau qui ung keit ción".split()
    prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(k))
    word = lambda: pick(DICTIONARY)
    uuid = lambda: f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-a{hexa(3)}-{hexa(12)}"
    secrets = [lambda: hexa(40), lambda: hexa(32), lambda: hexa(64), lambda: chars(low + up + dig, int(rng.integers(20, 50))), lambda: "AKIA" + chars(up + dig, 16), lambda: chars(low + up + dig + "+/", 40), lambda: "ghp_" + chars(low + up + dig, 36),
               lambda: f"xoxb-{chars(dig, 11)}-{chars(low + up + dig, 24)}", lambda: "sk_live_" + chars(low + up + dig, 24), lambda: "AIza" + chars(low + up + dig + "_-", 35), lambda: f"eyJ{chars(low + up + dig, 30)}.eyJ{chars(low + up + dig, 40)}.{chars(low + up + dig + '_-', 43)}",
               lambda: chars(low + up + dig + "+/", 43) + "=", lambda: "glpat-" + chars(low + up + dig, 20), lambda: word() + chars(dig, 2) + chars(low + up + dig + "-_", 14)]
    plain = [lambda: hexa(40), lambda: hexa(64), lambda: hexa(32), uuid, lambda: chars(dig, 16), lambda: "+" + chars(dig, 15), lambda: ".".join(chars(dig, int(rng.integers(1, 4))) for _ in range(6)), lambda: f"20{chars(dig, 2)}-0{chars('123456789', 1)}-1{chars(dig, 1)}T1{chars(dig, 1)}.{chars(dig, 6)}",
             lambda: "/".join(word() for _ in range(4)) + "/" + chars(dig, 3), lambda: f"{word()}-{word()}-{word()}-{chars(dig, 2)}", lambda: f"{word()}_{word()}_{word()}{chars(dig, 1)}", lambda: f"{word()}.{hexa(8)}.{pick(['js', 'css', 'chunk.js'])}", lambda: f"your_{word()}_key_here_{chars(dig, 2)}",
             lambda: "x" * int(rng.integers(16, 40)) + "1", lambda: "1234567890abcdef" + "0" * int(rng.integers(0, 17)), lambda: "sha512-" + chars(low + up + dig + "+/", 86) + "==", lambda: f"example-{word()}-0000{chars(dig, 4)}", lambda: word().title() + word().title() + word().title() + chars(dig, 2), lambda: chars(dig, 4) + "-" + chars(dig, 4) + "-" + chars(dig, 4) + "-" + chars(dig, 4)]
    names = "token secret api_key apiKey password access_token auth_token client_secret private_key SECRET_KEY AWS_SECRET_ACCESS_KEY DB_PASSWORD signing_key webhook_secret TOKEN API_KEY".split()
    other = "commit sha256 md5 checksum digest integrity id uuid etag version image file path url ref revision order tracking phone card isbn build".split()
    ways = ['{n} = "{v}"', "{n}={v}", "{n}: {v}", '"{n}": "{v}"', "export {n}={v}", "{n} => '{v}'", "--{n} {v}", "{n} {v}", "{n} := `{v}`"]
    bearer = ["Authorization: Bearer {v}", "https://user:{v}@host", "the {n} is {v} now"]
    quiet = ["{v}", "({v})", "see {v}", '"{v}"', "{n} {v}", "{n}: {v}", '{n} = "{v}"', "{n}={v}", "[{v}]"]
    safe, risky = ["src/main.py", "docs/guide.md", "tests/test_api.py", "yarn.lock", "CHANGELOG.md", "src3", "", "web/index.html"], ["config/prod.env", "deploy/settings.yaml", "src/app.js", "src12", "", "infra/main.tf", ".env"]
    passes = "password passphrase db_password DB_PASSWORD pwd passwd PASSWORD smtp_pass admin_password Passwort contraseña userPassword root_password secret".split()
    made = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(2, 5))))
    common = lambda: pick(COMMON) if rng.random() < 0.6 else made()
    german = "schtz keit ung heit sch berg enk geh chen bar lich ver ein stand zeug wirt schaft haupt bahn stell pfl ichter kraft".split()
    signs = "!@#$%^&*?-_+~=."
    phrase = lambda: pick([" ", " ", "-", "_", ".", ""]).join(common() for _ in range(int(rng.integers(3, 7))))
    leet = lambda x: "".join(dict(zip("aeiost", "431057")).get(c, c) if rng.random() < 0.5 else c for c in x)
    human = [lambda: common().title() + chars(dig, int(rng.integers(1, 5))) + chars(signs, int(rng.integers(0, 3))), lambda: 2 * (common() + chars(dig, 1)), lambda: leet(common()).title() + chars(signs, 1) + chars(dig, 1) + chars(signs, 1) + chars(low + up + dig, 5),
             lambda: chars(low + up + dig + signs, int(rng.integers(8, 25))), lambda: chars(low + up, int(rng.integers(8, 41))), lambda: chars(low, int(rng.integers(9, 25))), lambda: chars(low + up + dig, int(rng.integers(8, 16))), lambda: common() + chars(signs, 1) + common() + chars(dig, 2), lambda: leet(common() + common())]
    quoting = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}"', "{n} => '{v}'", "{n} := `{v}`", '{n}: str = "{v}"', 'set_{n}("{v}")', '("{n}", "{v}")', "<{n}>{v}</{n}>", '"{n}" value="{v}"', "{n} is '{v}'", '\\"{n}\\": \\"{v}\\"']
    code = [lambda: f'os.environ["{word().upper()}"]', lambda: f"{word()}.{word()}()", lambda: f"{word()}.{word()}.{word()}", lambda: f"{word()}_{word()}({word()})", lambda: f"self.{word()}_{word()}", lambda: f"${word().upper()}_{word().upper()}", lambda: f"${{{word().upper()}_{word()}}}", lambda: f"{{{{ {word()}.{word()} }}}}",
            lambda: f"<{word()}-{word()}>", lambda: f"%({word()})s", lambda: f"process.env.{word().upper()}", lambda: f"{word()}{word().title()}", lambda: f"{word().title()}[{word()}]", lambda: f"{word()}_{word()}", lambda: f"{word()}{word().title()}.{word()}", lambda: f"new {word().title()}({word()})"]
    nothing = lambda: pick(["changeme", "your-" + word(), "your_" + word() + "_here", "*" * int(rng.integers(6, 14)), "x" * int(rng.integers(6, 14)), "password", "secret", "undefined", "string", "nullptr", "required", "optional", "[REDACTED]", "<redacted>", "placeholder", "example-" + word(), "default", "passwort", "........", "enter-password", "[SECRET]"])
    label = lambda: pick(["Enter your {}", "The {} must have 8 characters", "Forgot your {}?", "Please repeat the {}", "Invalid {} or user name", "{} of the user", "Confirm {}", "Reset {}", "Wrong {}!", "{} has expired"]).format(pick(["password", "token", "secret", "key", "Passwort", "passphrase"]))
    said = ["{n} {v}", "{n} is {v}", "the {n} is {v} now", "{n}: {v}", "{n} was {v}", "{n} for the {v}", "{n}, {v}", "({n}) {v}", "--{n} {v}", "{n} ({v}"]

    def unshaped(good: int) -> tuple[str, str, str]:
        """(value, way, name)"""
        r = rng.random()
        if good:
            if r < 0.2:
                return phrase(), pick(quoting), pick(passes)
            if r < 0.3:
                return pick([lambda: chars(low, 7), common, made, lambda: chars(dig, 6) + chars("2468", 2)])().ljust(NAMED, "o"), pick(quoting[:8]), pick(passes)
            return pick(human)(), pick(ways + quoting + bearer), pick(passes + passes + names)
        if r < 0.3:
            return pick(code)(), pick(ways + quoting + ["{n}: str = {v}"]), pick(passes + names + ["key", "session", "cookie"])
        if r < 0.45:
            return nothing(), pick(ways + quoting), pick(passes + names)
        if r < 0.65:
            return pick([made, made, word, lambda: made().title(), lambda: made() + pick([",", ".", "!", ")", "?", ";"]), lambda: made() + "-" + made(), lambda: pick(COMMON)])().ljust(NAMED, "e"), pick(said), pick(passes + names + ["key", "session", "author", "Schlüssel key", "cookies", "tokens"])
        if r < 0.75:
            return label(), pick(quoting), pick(passes + names)
        if r < 0.83:
            return pick([lambda: f"{word()}_{word()}", lambda: f"{word()}-{word()}", lambda: word().ljust(NAMED, "s"), lambda: f"{word()}.{word()}", lambda: word().title() + word().title(), lambda: f"{word()} {word()}"])(), pick(quoting + ways), pick(["key", "session", "auth_type", "cookie", "primary_key", "sort_key", "token_type", "author", "session_name", "key_name"])
        if r < 0.97:
            return pick([lambda: pick([str.lower, str.title, str.upper])("".join(pick(syllables) for _ in range(int(rng.integers(6, 11))))), lambda: pick([str.lower, str.upper])("".join(pick(german) for _ in range(int(rng.integers(3, 7))))), lambda: word() + "".join(word().title() for _ in range(3)), lambda: "/".join(word() for _ in range(4)), lambda: "-".join(made() for _ in range(3)), lambda: "_".join(word() for _ in range(4)).upper(),
                         lambda: pick("-=._") * int(rng.integers(16, 80)), lambda: f"www.{made()}{made()}.{pick(['com', 'org', 'de'])}/{word()}/{word()}", lambda: f"org.{word()}.{word()}.{word()}.{word().title()}"])().ljust(SHORTEST, "e"), pick(["{v}", "({v})", "see {v}", "{v}.", '"{v}"']), ""
        return pick([lambda: chars("123456789", int(rng.integers(6, 10))), lambda: f"20{chars(dig, 2)}-0{chars('123456789', 1)}-1{chars(dig, 1)}", lambda: chars("123456789", 3) + ",000", lambda: f"{chars(dig, 2)}.{chars(dig, 4)}"])(), pick(ways), pick(["session_timeout", "max_tokens", "token_expires", "auth_date", "key", "tokens", "session_id_max"])

    out = []
    for k in range(n):
        good = k % 2
        if rng.random() < 1 / 3:
            value, way, name = unshaped(good)
            left, right = way.replace("{v}", "\0").replace("{n}", name).split("\0")
            out.append((value, (prose(int(rng.integers(0, 8))) + " " + left)[-BESIDE:], (right + " " + prose(int(rng.integers(0, 6))))[:BESIDE], pick(risky if good and rng.random() < 0.6 else safe + risky), good))
            continue
        value = pick(secrets if good else plain)()
        # a look-alike that could be a secret by its shape is told by its name; one that couldn't, may have any
        telling = not good and re.fullmatch(r"[0-9a-f]{32,64}", value)
        way = pick(ways + bearer) if good else pick(quiet if telling or rng.random() < 0.8 else ways)
        name = pick(names) if good or (not telling and rng.random() < 0.25) else pick(other)
        if good and rng.random() < 0.15:
            way, name = way.upper() if "{" not in way else way, name.upper()
        left, right = way.format(n=name, v="\0").split("\0")
        junk = pick(["", "", "", "###", "!!", " |", "%%%", ";", ",", "."])
        out.append((value, (prose(int(rng.integers(0, 8))) + " " + left)[-BESIDE:], (right + junk + " " + prose(int(rng.integers(0, 6))))[:BESIDE], pick(risky if good and rng.random() < 0.6 else safe + risky), good))
    return out


def train(findings) -> trees.Flat:
    x = np.array([features(*f[:4]) for f in findings])
    return trees.forest(x, np.array([f[4] for f in findings]))


@lru_cache(maxsize=1)
def default_forest() -> trees.Flat:
    return train(labelled_findings(8000))


def runs(s: tb.Slice, digit: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the candidates by shape of a slice; with digit, of those that have one."""
    n = len(s.data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _RUN[s.data]
    flips = np.diff(inside)
    start, end = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    cut = np.unique(s.offsets[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    if digit:
        digits = np.concatenate([[0], np.cumsum(_DIGIT[s.data])])
        has = digits[end] > digits[start]
        start, end = start[has], end[has]
    return np.searchsorted(s.offsets, start, side="right") - 1, start, end


def _bare(value: bytes) -> bytes:
    """Without what follows the value, and the signs that end a phrase, an argument or a bracket opened before it."""
    value = _ENDS.split(value, maxsplit=1)[0]
    while value:
        last = value[-1:]
        if last in b",;.\\" or last in b")]}" and value.count(last) > value.count({b")": b"(", b"]": b"[", b"}": b"{"}[last]):
            value = value[:-1]
        else:
            break
    return value


def named(raw: bytes) -> set[tuple[int, int]]:
    """(start, end) of the candidates by name of a text."""
    out = set()

    def add(m: re.Match | None, query: bool = False) -> None:
        if m is None:
            return
        kind = m.lastgroup
        value, a = m[kind], m.start(kind)
        if kind == "c":
            for x in _INNER.finditer(value):
                if x.end(x.lastgroup) - x.start(x.lastgroup) >= NAMED:
                    out.add((a + x.start(x.lastgroup), a + x.end(x.lastgroup)))
            value = _bare(re.split(rb"[&#]", value)[0] if query else value)
        if len(value.decode("utf-8", "ignore")) >= NAMED:
            out.add((a, a + len(value)))

    for m in _NAME.finditer(raw):
        a, end = m.span()
        while a and (raw[a - 1 : a].isalnum() or raw[a - 1] in b"_.-") and m.start() - a < 40:
            a -= 1
        query = a > 0 and raw[a - 1] in b"?&"
        assigned = _ASSIGNED.match(raw, end)
        if assigned:
            add(assigned, query)
            add(_TYPED.match(raw, end))
            add(_TAG.match(raw, end))
        else:
            add(_NEXT.match(raw, end))
            add(_SAID.match(raw, end))
    for m in _URL.finditer(raw):
        add(m)
    return out


def candidates(s: tb.Slice, texts: pa.Array) -> list[tuple[int, int, int]]:
    """(row, start, end) of the candidates of a slice, by shape and by name; texts: the slice's rows."""
    found = set()
    for row, a, b in zip(*(x.tolist() for x in runs(s, digit=False))):
        value = s.data[a:b].tobytes()
        while len(value) > 1 and value[-1:] in b".-=/" and not value.endswith(b"="):
            value = value[:-1]
        # name=value is one run: what stands before the = is the name
        head = re.match(rb"([A-Za-z_.-]{2,40}=)([^=].{%d,})" % (SHORTEST - 2), value)
        if head:
            a, value = a + len(head[1]), head[2]
        found.add((row, a, a + len(value)))
    for row in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _HAS_NAME), False).to_numpy(zero_copy_only=False)).tolist():
        lo, hi = int(s.offsets[row]), int(s.offsets[row + 1])
        found.update((row, lo + a, lo + b) for a, b in named(s.data[lo:hi].tobytes()))
    return sorted(found)


def scan(texts: pa.Array, paths: pa.Array, forest: trees.Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, first byte, bytes, score, value) of every candidate."""
    rows, firsts, x, values = [], [], [], []
    for s in tb.text_slices(texts, lower=False):
        for row, a, b in candidates(s, texts.slice(s.first, len(s.offsets) - 1)):
            lo, hi = s.offsets[row], s.offsets[row + 1]
            value = s.data[a:b].tobytes()
            text = lambda p, q: s.data[p:q].tobytes().decode("utf-8", "ignore")  # noqa: E731, B023
            path = paths[int(row + s.first)].as_py() or ""
            rows.append(row + s.first)
            firsts.append(a - lo)
            values.append(value)
            x.append(features(value.decode(), text(max(lo, a - BESIDE), a), text(b, min(hi, b + BESIDE)), str(path)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []
    return np.array(rows), np.array(firsts), np.array([len(v) for v in values]), forest.sums(np.array(x)), values


def secrets(texts: pa.Array, paths: pa.Array, forest: trees.Flat, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, bytes, score) of the secrets, in order; those that overlap are one, with the highest score."""
    row, first, size, score, _ = scan(texts, paths, forest)
    out: list[list] = []
    for k in np.lexsort((first, row)):
        if score[k] < least:
            continue
        r, a, b, p = int(row[k]), int(first[k]), int(first[k] + size[k]), float(score[k])
        if out and out[-1][0] == r and a < out[-1][2]:
            out[-1][2:] = [max(out[-1][2], b), max(out[-1][3], p)]
        else:
            out.append([r, a, b, p])
    r, a, b, p = np.array(out, float).reshape(-1, 4).T
    return r.astype(np.int64), a.astype(np.int64), (b - a).astype(np.int64), p


def _paths(docs: DataFrame):
    return F.col("source").cast("string") if "source" in docs.columns else F.lit("")


def findings(docs: DataFrame, least: float = LEAST, forest: trees.Flat | None = None) -> DataFrame:
    """(doc_id, first, size, score): the candidates that the forest takes for secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches):
        for batch in batches:
            row, first, size, score = secrets(batch["text"], batch["path"], shared.value, least)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), pa.array(first), pa.array(size), pa.array(score.round(4))], names=["doc_id", "first", "size", "score"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first long, size long, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), _paths(docs).alias("path")).mapInArrow(run, kinds)


def redact(docs: DataFrame, least: float = LEAST, forest: trees.Flat | None = None) -> DataFrame:
    """docs with every secret in text replaced by ``[SECRET]``, and n_chars counted anew where that happened."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    has_chars, has_path = "n_chars" in docs.columns, "source" in docs.columns

    def run(batches):
        for batch in batches:
            texts = batch["text"]
            paths = batch["source"].cast(pa.string()) if has_path else pa.nulls(len(texts), pa.string())
            row, first, size, _ = secrets(texts, paths, shared.value, least)
            if len(row):
                new = {}
                for r in np.unique(row).tolist():
                    own, raw, pieces, at = row == r, texts[r].as_py().encode(), [], 0
                    for a, n in zip(first[own].tolist(), size[own].tolist()):
                        pieces += [raw[at:a], MARK]
                        at = a + n
                    new[r] = b"".join([*pieces, raw[at:]])
                where = np.zeros(len(texts), bool)
                where[list(new)] = True
                fresh = [new[r].decode() for r in np.flatnonzero(where)]
                columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                columns["text"] = pc.replace_with_mask(texts, pa.array(where), pa.array(fresh, texts.type))
                if has_chars:
                    columns["n_chars"] = pc.replace_with_mask(batch["n_chars"], pa.array(where), pa.array([len(t) for t in fresh], batch["n_chars"].type))
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names=batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
