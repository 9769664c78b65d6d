"""Scores and rounds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutwise.functions.text import map_code

# Text that marks an unfinished or unplayed match.
RETIREMENT_MARKERS = ["RET", "W/O", "DEF", "ABN", "unfinished", "Walkover"]
# Round names and codes that do not depend on the draw size.
ROUND_CODES = {
    "final": "F", "finals": "F", "f": "F",
    "semifinal": "SF", "semi-final": "SF", "semi-finals": "SF", "sf": "SF",
    "quarterfinal": "QF", "quarter-final": "QF", "quarter-finals": "QF", "qf": "QF",
    "round robin": "RR", "group": "RR", "rr": "RR",
}
# Names of the numbered rounds.
NUMBERED_ROUNDS = {
    1: ["1r", "1st round", "1. round", "round of 128", "r128"],
    2: ["2r", "2nd round", "2. round", "round of 64", "r64"],
    3: ["3r", "3rd round", "3. round", "round of 32", "r32"],
    4: ["4r", "4th round", "4. round", "round of 16", "r16"],
}
# Sort position of each round code.
ROUND_POSITIONS = {
    "F": 300, "SF": 200, "QF": 150, "R16": 100, "R32": 50, "R64": 25, "R128": 1, "RR": 175, "BR": 175,
}


def _set_scores(score: Column) -> Column:
    """The "a-b" tokens of a score as (a, b) numbers; tie-break counts, other tokens and numbers beyond an int go."""
    bare = F.transform(F.split(F.trim(score), r"\s+"), lambda t: F.substring_index(t, "(", 1))
    read = F.transform(
        F.filter(bare, lambda t: t.rlike(r"^\d+-\d+$")),
        lambda t: F.struct(
            F.substring_index(t, "-", 1).try_cast("int").alias("a"),
            F.substring_index(t, "-", -1).try_cast("int").alias("b")))
    return F.filter(read, lambda s: s["a"].isNotNull() & s["b"].isNotNull())


def set_figures(score: Column) -> Column:
    """Sets won by each side and total games in one struct; the sets are read once, not again for each figure."""
    def figures(sets: Column) -> Column:
        games = F.aggregate(sets, F.lit(0).cast("long"), lambda acc, s: acc + s["a"] + s["b"]).try_cast("int")
        return F.struct(
            F.size(F.filter(sets, lambda s: s["a"] > s["b"])).alias("won"), F.size(F.filter(sets, lambda s: s["b"] > s["a"])).alias("lost"), games.alias("games"))

    return F.get(F.transform(F.array(_set_scores(score)), figures), F.lit(0))


def parse_score(score: Column, figures: Column | None = None) -> dict[str, Column]:
    """Sets won by each side, total games and the retirement flag; `figures` is a column that holds `set_figures` already."""
    figures = set_figures(score) if figures is None else figures
    won, lost, games = figures["won"], figures["lost"], figures["games"]
    decided = score.isNotNull() & (won + lost > 0)
    pattern = "|".join(m.lower() for m in RETIREMENT_MARKERS)
    return {
        "winner_sets_won": F.when(decided, won),
        "loser_sets_won": F.when(decided, lost),
        "total_games": F.when(games > 0, games),
        "is_retirement": F.coalesce(F.lower(score).rlike(pattern), F.lit(False)),
    }


def is_walkover(score: Column) -> Column:
    return F.coalesce(F.lower(score).contains("w/o"), F.lit(False))


def infer_winner(score: Column) -> dict[str, Column]:
    """Whether the side named first won more sets, and the match length the set count implies."""
    sets = _set_scores(score)
    first = F.size(F.filter(sets, lambda s: s["a"] > s["b"]))
    second = F.size(F.filter(sets, lambda s: s["b"] > s["a"]))
    return {
        "first_won": F.when(score.isNotNull(), first > second),
        "best_of": F.when(score.isNotNull(), F.when(F.size(sets) >= 4, 5).otherwise(3)),
    }


def numbered_round(number: Column, draw_size: Column) -> Column:
    """Code of the n-th round: the draw is filled up to a power of two and halves each round."""
    halvings = F.ceil(F.log2(draw_size.cast("double"))) - (number - 1)  # until one player is left
    codes = F.array(*[F.lit(c) for c in ("F", "F", "SF", "QF", "R16", "R32", "R64", "R128")])
    return F.coalesce(F.get(codes, F.greatest(F.lit(0), F.least(halvings, F.lit(7))).cast("int")), F.lit("F"))


def normalize_round(text: Column, draw_size: Column) -> Column:
    """Free round text to a code; unknown and missing text is R32."""
    key = F.lower(F.trim(text))
    number = F.coalesce(*[F.when(key.isin(names), F.lit(n)) for n, names in NUMBERED_ROUNDS.items()])
    return F.when(number.isNotNull(), numbered_round(number, draw_size)).otherwise(
        map_code(key, ROUND_CODES, F.lit("R32")))


def round_position(code: Column) -> Column:
    return map_code(code, {k: str(v) for k, v in ROUND_POSITIONS.items()}, F.lit("50")).cast("int")
