"""Number-plate text rules as DataFrame transforms.

Four rule sets ("profiles") are in use at different places of a gate system.
Each is described by a :class:`PlateProfile`; the two transforms
:func:`normalize_plates` and :func:`validate_plates` turn a profile into plain
column expressions.  Intermediate values are named columns, so Catalyst
evaluates every regular expression once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: state and union-territory codes -------------------------
STATE_CODES = (
    "AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP "
    "MZ NL OD PB PY RJ SK TN TR TS UK UP WB BH"
).split()
BROWSER_STATE_CODES = (
    "AN CH DD DL LD PY LA DH AP AR AS BR CG GA GJ HR HP JK JH KA KL MP MH MN "
    "ML MZ NL OD PB RJ SK TN TS TR UP UK WB BH"
).split()

# --- fixed values: misread state codes, by the state they stand for --------
FUSION_STATE_FIXES = {
    "TS": "TT TC T5 T0 IS 1S 7S JS YS FS PS T1",
    "DL": "0L OL 1L IL QL DI D1 CL UL",
    "HR": "HA HB HD H1 H0 MR KR",
    "MH": "HH NH KH VH WH MM MI MN HM TH WW M0 MA",
    "KA": "KB K0 K4 X4 XA KO",
    "KL": "KP KI XI K1",
    "TN": "TJ TM TA TI TL 7N IN",
    "UP": "UB UF U1 VP 0P OP",
    "GJ": "G1 G3 CJ",
    "RJ": "R1 R3",
    "WB": "W1 W8",
    "MP": "MD M1 MB",
    "AP": "A0 4P AL AR",
    "PB": "P1",
    "OD": "0D OR",
}
SERVICE_STATE_FIXES = {
    "MH": "HH NH KH VH WH MM MI MN MR HM TH WW",
    "DL": "0L OL 1L IL QL DI D1",
    "HR": "HA HB HD",
    "KA": "KB",
    "KL": "KP",
    "GJ": "G3",
    "RJ": "R3",
    "WB": "W8",
    "MP": "MB MD",
    "UP": "UB UF",
    "TN": "TJ TM",
}

# --- fixed values: character substitutions (from, to) ----------------------
FUSION_DIGITS = ("OQDCUILTJZEAHSGB", "0000011712344568")
FUSION_LETTERS = ("012345678", "OIZBASGTB")
SERVICE_DIGITS = ("OQDILZSBGT", "0001125867")
SERVICE_LETTERS = ("0125867", "OIZSBGT")
BROWSER_SWAP = ("OQILZSBG01568", "00112586OISGB")
MINIMAL_SWAP = ("OQI", "001")
FOLD_SWAP = ("OIBQS", "01805")

# --- fixed values: plate patterns ------------------------------------------
STANDARD = r"^[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{4}$"
BHARAT = r"^\d{2}BH\d{4}[A-Z]{1,2}$"
COMMERCIAL = r"^[A-Z]{2}\d{1,2}\d[A-Z]{0,3}\d{4}$"
TEMPORARY = r"^[A-Z]{2}\d{1,2}T[A-Z]{1,3}\d{4}$"
GOVERNMENT = r"^[A-Z]{2}\d{1,2}G[A-Z]{1,3}\d{4}$"
SHORT = r"^[A-Z]{2}\d{1,2}\d{4}$"
SINGLE_LETTER = r"^[A-Z]{2}\d{1,2}[A-Z]\d{4}$"
BY_LENGTH = {
    9: r"^[A-Z]{2}\d{2}[A-Z]\d{4}$",
    10: r"^[A-Z]{2}\d{2}[A-Z]{2}\d{4}$",
    11: r"^[A-Z]{2}\d{2}[A-Z]{3}\d{4}$",
}
CLIP_STRICT = r"^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{3,4}$"
CLIP_LOOSE = r"[A-Z0-9]{2}[0-9]{1,2}[A-Z0-9]{1,3}[0-9]{3,4}"
LONG_TAIL = (
    r"^([A-Z0-9]{2}[A-Z0-9]{1,2}[A-Z0-9]{1,3}[A-Z0-9]{4})\d{1,3}$",
    r"^([A-Z0-9]{2}[A-Z0-9]{1,2}[A-Z0-9]{1,3}[A-Z0-9]{4})[1IL7TI]$",
)
SHORT_TAIL = (
    r"^([A-Z0-9]{2}[A-Z0-9]{2}[A-Z0-9]{1,3}[A-Z0-9]{4})[1IL7TI]$",
    r"^([A-Z0-9]{2}\d{1,2}[A-Z0-9]{1,3}\d{4})\d$",
)


@dataclass(frozen=True)
class PlateProfile:
    """One rule set.

    ``lead`` are border characters dropped in front of a known state;
    ``lead_exclusive`` says a border character ends the prefix tests even when
    no state follows; ``drop_two`` allows a two-character border.  ``tails``
    are the trailing-artefact patterns, tried only above ``tail_min`` characters.
    ``length_rules`` maps a length to its four confidences (pattern and state,
    pattern only, state only, neither).
    """

    name: str
    states: tuple[str, ...]
    fixes: tuple[tuple[str, str], ...]
    digits: tuple[str, str]
    letters: tuple[str, str]
    lead: str
    lead_exclusive: bool
    drop_two: bool
    tails: tuple[str, str]
    tail_min: int
    passes: int
    patterns: tuple[str, ...]
    length_rules: tuple[tuple[int, tuple[float, float, float, float]], ...]
    pattern_conf: tuple[float, float]
    state_only_conf: float
    invalid_conf: float

    def fix_keys(self) -> list[str]:
        return [k for _, ks in self.fixes for k in ks.split()]


_COMMON = (STANDARD, BHARAT, COMMERCIAL, TEMPORARY, GOVERNMENT, SHORT)

FUSION = PlateProfile(
    name="fusion",
    states=tuple(STATE_CODES),
    fixes=tuple(FUSION_STATE_FIXES.items()),
    digits=FUSION_DIGITS,
    letters=FUSION_LETTERS,
    lead="EI1LTDBCUN",
    lead_exclusive=True,
    drop_two=True,
    tails=LONG_TAIL,
    tail_min=11,
    passes=1,
    patterns=_COMMON,
    length_rules=(
        (10, (0.98, 0.88, 0.85, 0.70)),
        (9, (0.96, 0.85, 0.82, 0.68)),
        (11, (0.95, 0.85, -1.0, -1.0)),
    ),
    pattern_conf=(0.92, 0.75),
    state_only_conf=0.70,
    invalid_conf=0.30,
)
VIDEO = PlateProfile(
    name="video",
    states=tuple(STATE_CODES),
    fixes=tuple(FUSION_STATE_FIXES.items()),
    digits=FUSION_DIGITS,
    letters=FUSION_LETTERS,
    lead="EI1LTDBCUN",
    lead_exclusive=True,
    drop_two=True,
    tails=LONG_TAIL,
    tail_min=11,
    passes=1,
    patterns=_COMMON + (SINGLE_LETTER,),
    length_rules=(),
    pattern_conf=(0.98, 0.85),
    state_only_conf=0.80,
    invalid_conf=0.20,
)
SERVICE = PlateProfile(
    name="service",
    states=tuple(STATE_CODES),
    fixes=tuple(SERVICE_STATE_FIXES.items()),
    digits=SERVICE_DIGITS,
    letters=SERVICE_LETTERS,
    lead="1ILT",
    lead_exclusive=False,
    drop_two=False,
    tails=SHORT_TAIL,
    tail_min=0,
    passes=2,
    patterns=_COMMON + (SINGLE_LETTER,),
    length_rules=(),
    pattern_conf=(0.98, 0.85),
    state_only_conf=0.80,
    invalid_conf=0.20,
)
BROWSER = PlateProfile(
    name="browser",
    states=tuple(BROWSER_STATE_CODES),
    fixes=tuple(SERVICE_STATE_FIXES.items()),
    digits=SERVICE_DIGITS,
    letters=SERVICE_LETTERS,
    lead="1ILT",
    lead_exclusive=False,
    drop_two=False,
    tails=SHORT_TAIL,
    tail_min=0,
    passes=1,
    patterns=(STANDARD, BHARAT, COMMERCIAL, TEMPORARY, GOVERNMENT),
    length_rules=(),
    pattern_conf=(0.0, 0.0),
    state_only_conf=0.45,
    invalid_conf=0.10,
)
PROFILES = {p.name: p for p in (FUSION, VIDEO, SERVICE, BROWSER)}


def _profile(profile: str | PlateProfile) -> PlateProfile:
    return profile if isinstance(profile, PlateProfile) else PROFILES[profile]


# --- single-column keys ------------------------------------------------------
def plate_key(text: Column) -> Column:
    """Lookup key: upper case without spaces and hyphens."""
    return F.translate(F.upper(F.coalesce(text, F.lit(""))), " -", "")


def plate_clean(text: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def swap_browser(text: Column) -> Column:
    """One pass of the browser letter/digit swap (it is its own near-inverse)."""
    return F.translate(text, *BROWSER_SWAP)


def minimal_fix(text: Column) -> Column:
    """O and Q become 0, I becomes 1."""
    return F.translate(text, *MINIMAL_SWAP)


def folded_key(text: Column) -> Column:
    """Confusion-folded match key; apply to both sides of an equi-join."""
    return F.translate(plate_clean(text), *FOLD_SWAP)


def state_code(plate: Column) -> Column:
    """First two characters, or ``IN`` for shorter texts."""
    return F.when(F.length(plate) >= 2, F.substring(plate, 1, 2)).otherwise(F.lit("IN"))


def confidence_gate(confidence: Column, floor: float = 0.40) -> Column:
    """Clamp to [0, 1] and zero out below ``floor``."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.when(clamped < floor, F.lit(0.0)).otherwise(clamped)


# --- normalisation -------------------------------------------------------------
def _quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _known_state(text: str, start: int, p: PlateProfile) -> Column:
    """Whether two characters of a text column are a state or a misread one."""
    return F.expr(f"substr(`{text}`, {start}, 2) in ({_quoted([*p.states, *p.fix_keys()])})")


def is_state(text: str, states) -> Column:
    """Whether the text column starts with one of ``states``."""
    return F.expr(f"substr(`{text}`, 1, 2) in ({_quoted(states)})")


def _strip_prefix(text: str, p: PlateProfile) -> Column:
    c, n = F.col(text), F.length(text)
    first_known = _known_state(text, 2, p)
    has_lead = (n >= 11) & F.expr(f"substr(`{text}`, 1, 1) in ({_quoted(p.lead)})")
    rest = (
        F.when(c.startswith("IND") & (n >= 7), c.substr(F.lit(4), n))
        .when(c.startswith("IN") & (n >= 8) & _known_state(text, 3, p), c.substr(F.lit(3), n))
    )
    if p.lead_exclusive:
        rest = rest.when(has_lead, F.when(first_known, c.substr(F.lit(2), n)).otherwise(c))
    else:
        rest = rest.when(has_lead & first_known, c.substr(F.lit(2), n))
    if p.drop_two:
        rest = rest.when((n >= 12) & _known_state(text, 3, p), c.substr(F.lit(3), n))
    return rest.otherwise(c)


def _strip_tail(c: Column, p: PlateProfile) -> Column:
    first = F.regexp_extract(c, p.tails[0], 1)
    second = F.regexp_extract(c, p.tails[1], 1)
    cut = F.when(first != "", first).when(second != "", second).otherwise(c)
    return F.when(F.length(c) >= p.tail_min, cut).otherwise(c) if p.tail_min else cut


def normalize_plates(
    df: DataFrame,
    text: str,
    out: str,
    profile: str | PlateProfile = FUSION,
    faithful: bool = True,
) -> DataFrame:
    """Add ``out``: the text without noise, country prefix and border artefacts.

    ``faithful=False`` keeps complete 11-character plates and Bharat-series
    plates that the artefact rules would otherwise cut.
    """
    p = _profile(profile)
    raw, cut = f"_{out}_raw", f"_{out}_cut"
    df = df.withColumn(raw, plate_clean(F.col(text)))
    df = df.withColumn(cut, F.when(F.length(raw) < 4, F.lit("")).otherwise(_strip_prefix(raw, p)))
    done = _strip_tail(F.col(cut), p)
    if not faithful:
        keep = F.col(cut).rlike(BY_LENGTH[11]) | F.col(cut).rlike(BHARAT)
        done = F.when(keep, F.col(cut)).otherwise(done)
    return df.withColumn(out, done).drop(raw, cut)


# --- validation ------------------------------------------------------------------
def _fix_state(code: str, p: PlateProfile, keep_valid: bool) -> Column:
    """The state meant by a two-character column."""
    keep = f"when `{code}` in ({_quoted(p.states)}) then `{code}`" if keep_valid else ""
    fixes = " ".join(f"when `{code}` in ({_quoted(keys.split())}) then '{target}'" for target, keys in p.fixes)
    return F.expr(f"case {keep} {fixes} else `{code}` end")


def _any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | c.rlike(pattern)
    return hit


def validate_plates(
    df: DataFrame,
    text: str,
    out: str,
    profile: str | PlateProfile = FUSION,
    faithful: bool = True,
) -> DataFrame:
    """Add ``{out}_valid``, ``{out}_conf`` and ``{out}_plate``.

    The browser profile also adds ``{out}_status``, ``{out}_pattern`` and
    ``{out}_corrections``.
    """
    p = _profile(profile)
    if p.name == "browser":
        return _validate_browser(df, text, out, p)
    n_col, src = f"_{out}_n", text
    for _ in range(p.passes):
        df = normalize_plates(df, src, n_col, p, faithful)
        src = n_col
    body, lead, state, strict = (f"_{out}_{s}" for s in ("body", "lead", "state", "strict"))
    c, n = F.col(n_col), F.length(n_col)
    mid = F.translate(c.substr(F.lit(5), n - 8), *p.letters)
    df = df.withColumn(lead, F.translate(F.substring(c, 1, 2), *p.letters))
    df = df.withColumn(strict, _fix_state(lead, p, keep_valid=True))
    df = df.withColumn(
        body,
        F.when(
            n >= 8,
            F.concat(
                F.translate(F.substring(c, 3, 2), *p.digits),
                F.when((n == 10) & (F.col(strict) == "TS") & (mid == "BS"), F.lit("JS")).otherwise(mid),
                F.translate(c.substr(n - 3, F.lit(4)), *p.digits),
            ),
        ).otherwise(F.translate(c.substr(F.lit(3), n), *p.digits)),
    )
    keep = n.isin(9, 10)
    if any(length == 11 for length, _ in p.length_rules):
        keep = keep | ((n == 11) & F.concat(F.col(strict), F.col(body)).rlike(BY_LENGTH[11]))
    df = df.withColumn(
        state, F.when(keep, F.col(strict)).otherwise(_fix_state(lead, p, keep_valid=False))
    )
    plate = f"{out}_plate"
    whole = F.concat(F.col(state), F.col(body))
    if not faithful:
        whole = F.when(c.rlike(BHARAT), c).otherwise(whole)
    df = df.withColumn(plate, F.when(n < 4, c).otherwise(whole))
    known = is_state(state, p.states)
    conf = F.when(n < 4, F.lit(0.0))
    if not faithful:
        conf = conf.when(c.rlike(BHARAT), F.lit(p.pattern_conf[0]))
    for length, (both, pattern_only, state_only, neither) in p.length_rules:
        match = F.col(plate).rlike(BY_LENGTH[length])
        conf = conf.when((n == length) & match, F.when(known, F.lit(both)).otherwise(F.lit(pattern_only)))
        if state_only >= 0:
            conf = conf.when(n == length, F.when(known, F.lit(state_only)).otherwise(F.lit(neither)))
    conf = (
        conf.when(
            _any_pattern(F.col(plate), p.patterns),
            F.when(known, F.lit(p.pattern_conf[0])).otherwise(F.lit(p.pattern_conf[1])),
        )
        .when(n.between(8, 11) & known, F.lit(p.state_only_conf))
        .otherwise(F.lit(p.invalid_conf))
    )
    df = df.withColumn(f"{out}_conf", conf)
    df = df.withColumn(f"{out}_valid", F.col(f"{out}_conf") > p.invalid_conf)
    if p.name == "service":
        df = df.withColumn(plate, F.when(F.col(n_col) == "", F.lit("No text")).otherwise(F.col(plate)))
    return df.drop(n_col, body, lead, state, strict)


def _class_count(part: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(part, f"[^{chars}]", ""))


def _validate_browser(df: DataFrame, text: str, out: str, p: PlateProfile) -> DataFrame:
    raw, cut, lead, fixed, count = (f"_{out}_{s}" for s in ("raw", "cut", "lead", "fixed", "count"))
    df = df.withColumn(raw, plate_clean(F.col(text)))
    usable = F.length(raw).between(4, 15)
    df = df.withColumn(cut, _strip_tail(_strip_prefix(raw, p), p))
    c, n = F.col(cut), F.length(cut)
    df = df.withColumn(lead, F.translate(F.substring(c, 1, 2), *p.letters))
    head = F.col(lead)
    state = _fix_state(lead, p, keep_valid=True)
    rto, series, number = F.substring(c, 3, 2), c.substr(F.lit(5), n - 8), c.substr(n - 3, F.lit(4))
    corrected = F.concat(
        state, F.translate(rto, *p.digits), F.translate(series, *p.letters), F.translate(number, *p.digits)
    )
    touched = (
        _class_count(F.substring(c, 1, 2), p.letters[0])
        + F.when(state != head, 1).otherwise(0)
        + _class_count(rto, p.digits[0])
        + _class_count(series, p.letters[0])
        + _class_count(number, p.digits[0])
    )
    in_range = n.between(8, 11)
    df = df.withColumn(fixed, F.when(in_range, corrected).otherwise(c))
    df = df.withColumn(count, F.when(in_range, touched).otherwise(F.lit(0)))
    x = F.col(fixed)
    raw_state, fixed_state = is_state(cut, p.states), is_state(fixed, p.states)
    # fixed values: (pattern name, condition, confidence, uses the corrected text)
    steps = [
        ("STANDARD_STRICT", c.rlike(STANDARD), F.when(raw_state, 1.0).otherwise(0.90), False),
        ("BHARAT_SERIES_STRICT", c.rlike(BHARAT), F.lit(0.98), False),
        ("COMMERCIAL_STRICT", c.rlike(COMMERCIAL), F.when(raw_state, 0.95).otherwise(0.85), False),
        ("TEMPORARY_STRICT", c.rlike(TEMPORARY), F.lit(0.92), False),
        ("GOVERNMENT_STRICT", c.rlike(GOVERNMENT), F.lit(0.95), False),
        ("STANDARD_POSITION_CORRECTED", x.rlike(STANDARD), F.when(fixed_state, 0.88).otherwise(0.75), True),
        ("BHARAT_CORRECTED", x.rlike(BHARAT), F.lit(0.85), True),
        ("COMMERCIAL_CORRECTED", x.rlike(COMMERCIAL), F.when(fixed_state, 0.82).otherwise(0.70), True),
        ("TEMPORARY_CORRECTED", x.rlike(TEMPORARY), F.lit(0.80), True),
        ("GOVERNMENT_CORRECTED", x.rlike(GOVERNMENT), F.lit(0.82), True),
        ("SHORT_FORMAT_CORRECTED", x.rlike(SHORT) & fixed_state, F.lit(0.80), True),
        ("STATE_CODE_MATCHED_ONLY", in_range & is_state(lead, p.states), F.lit(p.state_only_conf), True),
    ]
    pattern = F.when(~usable, F.lit(None).cast("string"))
    for name, hit, _, _ in steps:
        pattern = pattern.when(hit, F.lit(name))
    df = df.withColumn(f"{out}_pattern", pattern)
    conf, plate, corrections = (F.when(~usable, v) for v in (F.lit(0.0), F.col(raw), F.lit(None).cast("int")))
    for name, _, value, uses_fixed in steps:
        hit = F.col(f"{out}_pattern") == name
        conf = conf.when(hit, value)
        if uses_fixed:
            plate = plate.when(hit, x)
            corrections = corrections.when(hit, F.col(count))
    df = df.withColumn(f"{out}_conf", conf.otherwise(F.lit(p.invalid_conf)))
    df = df.withColumn(f"{out}_plate", plate.otherwise(c))
    df = df.withColumn(f"{out}_corrections", corrections.otherwise(F.lit(0)))
    df = df.withColumn(
        f"{out}_status",
        F.when(~usable, F.lit("LOW_CONFIDENCE"))
        .when(F.col(f"{out}_conf") > p.state_only_conf, F.lit("VALID"))
        .otherwise(F.lit("INVALID")),
    )
    df = df.withColumn(f"{out}_valid", F.col(f"{out}_status") == "VALID")
    return df.drop(raw, cut, lead, fixed, count)
