"""What a search asks for; known to the driver, so it enters plans as literals."""

from __future__ import annotations

import dataclasses

from postlake import dictionaries as D
from postlake.functions.text import query_terms, words_pattern


@dataclasses.dataclass(frozen=True)
class Criteria:
    query: str = "DevOps Engineer"
    min_experience: int | None = None
    max_experience: int | None = None
    posted_within_days: int | None = 14
    remote_only: bool = True
    global_or_india: bool = True
    exclude_indian: bool = True
    strict_experience: bool = False
    strict_title: bool = False
    strict_junior: bool = False
    seniority_levels: tuple[str, ...] = ()
    as_of: str = "2024-01-31 00:00:00"

    @property
    def terms(self) -> list[str]:
        return query_terms(self.query)

    @property
    def role(self) -> str | None:
        import re

        return next((r for r, w in D.ROLES.items() if re.search(words_pattern(w), self.query.lower())), None)
