"""Joint names: namespaces, plain spelling and meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What plain joint names mean, and the core of a humanoid.
ALIASES = {
    "hips": "pelvis", "pelvis": "pelvis", "root": "root", "rootmotion": "root",
    "neck": "neck", "neck01": "neck", "head": "head", "head1": "head",
    "leftshoulder": "left_clavicle", "claviclel": "left_clavicle", "leftcollar": "left_clavicle",
    "rightshoulder": "right_clavicle", "clavicler": "right_clavicle", "rightcollar": "right_clavicle",
    "leftarm": "left_upper_arm", "upperarml": "left_upper_arm", "leftupperarm": "left_upper_arm", "leftshouldersmpl": "left_upper_arm",
    "rightarm": "right_upper_arm", "upperarmr": "right_upper_arm", "rightupperarm": "right_upper_arm", "rightshouldersmpl": "right_upper_arm",
    "leftforearm": "left_lower_arm", "lowerarml": "left_lower_arm", "leftelbow": "left_lower_arm",
    "rightforearm": "right_lower_arm", "lowerarmr": "right_lower_arm", "rightelbow": "right_lower_arm",
    "lefthand": "left_hand", "handl": "left_hand", "leftwrist": "left_hand",
    "righthand": "right_hand", "handr": "right_hand", "rightwrist": "right_hand",
    "leftupleg": "left_thigh", "thighl": "left_thigh", "lefthip": "left_thigh",
    "rightupleg": "right_thigh", "thighr": "right_thigh", "righthip": "right_thigh",
    "leftleg": "left_calf", "calfl": "left_calf", "leftknee": "left_calf",
    "rightleg": "right_calf", "calfr": "right_calf", "rightknee": "right_calf",
    "leftfoot": "left_foot", "footl": "left_foot", "leftankle": "left_foot",
    "rightfoot": "right_foot", "footr": "right_foot", "rightankle": "right_foot",
    "lefttoebase": "left_toe", "balll": "left_toe", "lefttoe": "left_toe",
    "righttoebase": "right_toe", "ballr": "right_toe", "righttoe": "right_toe",
}
CORE = [
    "pelvis", "spine", "neck", "head", "left_clavicle", "right_clavicle", "left_upper_arm", "right_upper_arm",
    "left_lower_arm", "right_lower_arm", "left_hand", "right_hand", "left_thigh", "right_thigh", "left_calf", "right_calf",
    "left_foot", "right_foot", "left_toe", "right_toe",
]
NAMESPACE = "mixamorig"


#: Letters whose folded form is not their lower case and has plain letters, as sharp s and ligatures.
FOLDED = {c: f for c, f in ((chr(i), chr(i).casefold()) for i in range(128, 0xFFFF)) if f != c.lower() and any(x.isascii() and x.isalnum() for x in f)}


def folded(text: Column) -> Column:
    """Lower case; in names with other letters also what folds to plain ones."""
    out = F.lower(text)
    for c, f in FOLDED.items():
        out = F.replace(out, F.lit(c), F.lit(f))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(F.lower(text))


def local_name(name: Column) -> Column:
    """What stands after the last colon, without white space around it."""
    return F.regexp_replace(F.substring_index(name, ":", -1), r"(?U)^\s+|\s+$", "")


def plain_name(name: Column) -> Column:
    return F.regexp_replace(folded(F.substring_index(name, ":", -1)), "[^a-z0-9]", "")


def plain(name: str) -> str:
    """``plain_name`` on the driver."""
    return "".join(c for c in name.rsplit(":", 1)[-1].casefold() if c.isascii() and c.isalnum())


def meanings(of: list[str]) -> list[str]:
    """``meaning`` of a skeleton's names on the driver."""
    out = []
    for n in of:
        p = plain(n).removeprefix(NAMESPACE)
        out.append("spine" if p.startswith("spine") else f"twist:{p}" if "twist" in p else ALIASES.get(p, p))
    return out


def meanings_in(of: list[str]) -> list[str]:
    """``meaning_in`` of a skeleton's names on the driver."""
    plains = [plain(n) for n in of]
    arms = {"leftshoulder": "left_upper_arm", "rightshoulder": "right_upper_arm"} if {"leftcollar", "rightcollar"} & {*plains} else {}
    return [arms.get(p, m) for p, m in zip(plains, meanings(of), strict=True)]


def meaning(name: Column) -> Column:
    """What a joint is: an alias of a core joint, ``spine``, ``twist:...``, or its own plain name."""
    plain = plain_name(name)
    plain = F.when(F.startswith(plain, F.lit(NAMESPACE)), F.substr(plain, F.lit(len(NAMESPACE) + 1))).otherwise(plain)
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return (
        F.when(F.startswith(plain, F.lit("spine")), F.lit("spine"))
        .when(F.contains(plain, F.lit("twist")), F.concat(F.lit("twist:"), plain))
        .otherwise(F.coalesce(F.element_at(table, plain), plain))
    )


def meaning_in(name: Column, collars: Column) -> Column:
    """``meaning``, where in skeletons that have collars (``collars``) the shoulders are the upper arms."""
    plain = plain_name(name)
    arm = F.when(plain == "leftshoulder", "left_upper_arm").when(plain == "rightshoulder", "right_upper_arm")
    return F.when(collars, F.coalesce(arm, meaning(name))).otherwise(meaning(name))
