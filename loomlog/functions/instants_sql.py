"""The reading of written times once more, in SQL for DuckDB, to check ``instants`` against."""

from __future__ import annotations

from .instants import LETTERS, MONTHS

_CLOCK, _CLOCK_NAMES = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?", ["h", "mi", "s", "f"]
_ZONE = r"(?: ?(?:([Zz])|([+-])(\d{2})(?::?(\d{2}))?|(" + "|".join(LETTERS) + r")|([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)))?(?:\[([A-Za-z0-9_+/-]+)\])?"
_ZONE_NAMES = ["z", "sg", "oh", "om", "l", "r", "b"]
_TAIL, _TAIL_NAMES = _CLOCK + _ZONE, [*_CLOCK_NAMES, *_ZONE_NAMES]
#: name of a form -> its pattern and the names of its groups
FORMS = {
    "dashes": (rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]{_TAIL})?", ["y", "mo", "d", *_TAIL_NAMES]),
    "slashes": (rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[Tt ]{_TAIL})?", ["y", "mo", "d", *_TAIL_NAMES]),
    "compact": (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}", ["y", "mo", "d", "h", "mi", "s", "f", *_ZONE_NAMES]),
    "month_first": (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK}(?: ?([AaPp])[Mm])?{_ZONE})?", ["mo", "d", "y", *_CLOCK_NAMES, "ap", *_ZONE_NAMES]),
    "mail": (rf"(?:[A-Z][a-z]{{2}}, ?)?(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}}) {_TAIL}", ["d", "mo", "y", *_TAIL_NAMES]),
    "signs": (rf"(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(?: ?{_TAIL})?", ["y", "mo", "d", *_TAIL_NAMES]),
}
_ALL = ["y", "mo", "d", *_CLOCK_NAMES, "ap", *_ZONE_NAMES]
WRITTEN_WELL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"


def timed(rows: str, out: str) -> str:
    """CTEs that add ``instant_us`` to ``rows``, a SELECT with ``written`` and ``source_id``; the last is called ``out``."""
    found = " ".join(
        f"WHEN regexp_matches(w_, '^(?:{pattern})$') THEN (SELECT {{{', '.join(f"'{n}': {f'x.{n}' if n in names else repr('')}" for n in _ALL)}}} FROM (SELECT regexp_extract(w_, '^(?:{pattern})$', [{', '.join(map(repr, names))}]) AS x))"
        for pattern, names in FORMS.values()
    )
    n = lambda k: f"try_cast(nullif(p_.{k}, '') AS BIGINT)"
    letters = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LETTERS.items())
    return f"""
    {out}_w AS (SELECT r.*, regexp_replace(r.written, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS w_, z.zone_ FROM ({rows}) r LEFT JOIN (SELECT source_id AS source_, min(zone_name) AS zone_ FROM sources GROUP BY source_id) z ON z.source_ = r.source_id),
    {out}_p AS (SELECT *, CASE {found} END AS p_, regexp_extract(w_, '^(\\d{{15,16}}|\\d{{12,13}}|\\d{{9,10}})(?:\\.(\\d+))?$', ['n', 'f']) AS n_ FROM {out}_w),
    {out}_n AS (SELECT *, {n('y')} AS y_, coalesce(nullif(list_position({MONTHS!r}, p_.mo), 0), {n('mo')}) AS mo_, {n('d')} AS d_, coalesce({n('mi')}, 0) AS mi_, coalesce({n('s')}, 0) AS s_,
        CASE WHEN p_.ap = '' THEN coalesce({n('h')}, 0) WHEN {n('h')} BETWEEN 1 AND 12 THEN {n('h')} % 12 + CASE WHEN lower(p_.ap) = 'p' THEN 12 ELSE 0 END END AS h_, rpad(substring(p_.f, 1, 6), 6, '0')::BIGINT AS f_,
        CASE WHEN p_.z <> '' THEN 0 WHEN p_.sg <> '' THEN CASE WHEN {n('oh')} <= 18 AND coalesce({n('om')}, 0) <= 59 THEN ({n('oh')} * 60 + coalesce({n('om')}, 0)) * CASE WHEN p_.sg = '-' THEN -1 ELSE 1 END END WHEN p_.l <> '' THEN CASE p_.l {letters} END END AS off_,
        p_.z <> '' OR p_.sg <> '' OR p_.l <> '' AS states_, coalesce(nullif(p_.r, ''), nullif(p_.b, ''), zone_, 'UTC') AS region_, rpad(substring(n_.f, 1, 6), 6, '0') AS nf_ FROM {out}_p),
    {out}_l AS (SELECT *, region_ IN (SELECT name FROM pg_timezone_names()) AS known_,
        CASE WHEN h_ <= 23 AND mi_ <= 59 AND s_ <= 59 AND y_ >= 1 THEN epoch_us(try_cast(printf('%04d-%02d-%02d', y_, mo_, d_) AS TIMESTAMP)) + ((h_ * 60 + mi_) * 60 + s_) * 1000000 + f_ END AS local_ FROM {out}_n),
    {out}_z AS (SELECT *, epoch_us(timezone(CASE WHEN known_ THEN region_ ELSE 'UTC' END, make_timestamp(local_))) AS at_ FROM {out}_l),
    {out} AS (SELECT * EXCLUDE (w_, zone_, p_, n_, y_, mo_, d_, mi_, s_, h_, f_, off_, states_, region_, nf_, known_, local_, at_), CASE
        WHEN length(n_.n) BETWEEN 1 AND 10 THEN try_cast(n_.n AS BIGINT) * 1000000 + nf_::BIGINT WHEN length(n_.n) BETWEEN 11 AND 13 THEN try_cast(n_.n AS BIGINT) * 1000 + substring(nf_, 1, 3)::BIGINT WHEN n_.n <> '' THEN try_cast(n_.n AS BIGINT)
        WHEN states_ THEN local_ - off_ * 60000000 WHEN region_ = 'UTC' THEN local_ WHEN NOT known_ THEN NULL
        WHEN timezone(CASE WHEN known_ THEN region_ ELSE 'UTC' END, make_timestamptz(at_ - 3600000000)) = make_timestamp(local_) THEN at_ - 3600000000 ELSE at_ END AS instant_us FROM {out}_z)"""
