"""Word lists and maps that normalization uses."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger(__name__)

# Lists and maps that must equal the published ones for equal results.
DESIGNATORS = """
    inc incorporated corp corporation company co ltd limited plc llc llp lp gmbh ag sa sas sarl bv nv oy ab kk pty pte srl spa se kg ohg ug eg ev mbh sprl
    cvba vof snc sca scs as aps hf ehf slp sl ltda cia sdn bhd tbk pt
""".split()
STOPWORDS = "the of and for a an".split()
BRANCH = """
    bank banking banks capital capitals securities security asset assets management invest investment investments investing investor investors fund funds
    funding holdings holding partners partner partnership financial finance financing wealth advisory advisors advisor trust trusts trustee insurance
    assurance brokerage broker brokers trading traders group services service solutions ventures venture equity credit lending savings
""".split()
INSTITUTION = [*BRANCH, "securities", "sec"]
LOCATION = """
    usa us uk europe european america american americas asia asian pacific africa african middle east eastern western northern southern central
    continental global international worldwide national regional local north south west latin greater apac emea latam amer apj germany german france
    french spain spanish italy italian netherlands dutch belgium belgian switzerland swiss suisse austria austrian sweden swedish norway norwegian denmark
    danish finland finnish poland polish ireland irish scotland scottish portugal portuguese greece greek russia russian china chinese japan japanese
    korea korean india indian singapore hong kong taiwan indonesia malaysia thailand vietnam philippines australia australian zealand canada canadian
    mexico mexican brazil brazilian argentina chile colombia uae emirates saudi arabia arabian qatar kuwait bahrain israel turkey turkish egypt eu nyc la
    sf dc
""".split()
ACRONYM_COLLISION = "abc aaa aab usa".split()
ALIASES = {
    "inc.": "inc",
    "corp.": "corp",
    "co.": "co",
    "ltd.": "ltd",
    "l.l.c": "llc",
    "l.l.c.": "llc",
    "l.l.p": "llp",
    "l.l.p.": "llp",
    "l.p.": "lp",
    "p.l.c": "plc",
    "p.l.c.": "plc",
    "pty.": "pty",
    "pte.": "pte",
    "pvt.": "pvt",
    "pvt": "pvt",
    "intl": "international",
    "intl.": "international",
    "natl": "national",
    "natl.": "national",
    "assoc": "association",
    "assoc.": "association",
    "bros": "brothers",
    "bros.": "brothers",
    "mfg": "manufacturing",
    "mfg.": "manufacturing",
    "svcs": "services",
    "svcs.": "services",
    "svc": "service",
    "svc.": "service",
    "tech": "technology",
    "techs": "technologies",
}
REPLACEMENTS = {"&": " and ", "+": " and "}


@dataclass(frozen=True)
class Lexicon:
    """Everything that normalization looks up.  acronym_collision is also a category, as published."""

    designators: tuple[str, ...] = tuple(DESIGNATORS)
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    replacements: dict[str, str] = field(default_factory=lambda: dict(REPLACEMENTS))
    collisions: tuple[str, ...] = tuple(ACRONYM_COLLISION)
    categories: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"acronym_collision": tuple(ACRONYM_COLLISION), "branch": tuple(BRANCH), "institution": tuple(INSTITUTION), "location": tuple(LOCATION), "stopwords": tuple(STOPWORDS)}
    )

    def category_names(self) -> list[str]:
        return sorted(self.categories)

    def words(self, *categories: str) -> list[str]:
        """The union of categories; an unknown one is warned of and empty."""
        for c in categories:
            if c not in self.categories:
                log.warning("unknown category of words: %s", c)
        return sorted({w for c in categories for w in self.categories.get(c, ())})


def _words(path: Path) -> tuple[str, ...]:
    return tuple(w for line in path.read_text(encoding="utf-8").splitlines() if (w := line.strip().lower())) if path.exists() else ()


def load_lexicon(folder: str | None = None) -> Lexicon:
    """The packaged lists, or those of a folder (argument or NAMEWRIGHT_LEXICON): one word a line,
    maps as JSON; missing files are empty, a broken alias map too, a broken replacement map raises."""
    folder = folder or os.environ.get("NAMEWRIGHT_LEXICON")
    if not folder:
        return Lexicon()
    root = Path(folder)

    def mapping(name: str, strict: bool) -> dict[str, str]:
        try:
            return json.loads((root / name).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return {}
        except json.JSONDecodeError:
            if strict:
                raise
            return {}

    collisions = tuple(line.strip() for line in (root / "acronym_collision.txt").read_text(encoding="utf-8").splitlines() if line.strip())
    categories = {p.stem: _words(p) for p in root.glob("*.txt") if p.stem != "designators_global"}
    return Lexicon(_words(root / "designators_global.txt"), mapping("designator_aliases.json", False), mapping("replacements.json", True), collisions, categories)
