"""Text matching and the content rules, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns of the content rules.
TEXT_LIMIT = 200
NAME_LIMIT = 50
QUESTION_MARK = "?"
FORBIDDEN_CHARACTERS = "[!¡.]"
EMAIL_FORMAT = r"\A[\w\-\.]+@([\w\-]+\.)+[\w\-]{2,}\z"
USERNAME_FORMAT = r"\A[\w\-\.]+\z"
# What each rule reports.
TEXT_BLANK = "Text can't be blank"
TEXT_TOO_LONG = "Text is too long (maximum is 200 characters)"
TEXT_NOT_QUESTION = "Text must only have questions"
EMAIL_INVALID = "Email is invalid"
EMAIL_BLANK = "Email can't be blank"
USERNAME_INVALID = "Username is invalid"
USERNAME_BLANK = "Username can't be blank"
USERNAME_TOO_LONG = "Username is too long (maximum is 50 characters)"
DISPLAY_NAME_BLANK = "Display name can't be blank"
DISPLAY_NAME_TOO_LONG = "Display name is too long (maximum is 50 characters)"


def like_pattern(term: str) -> str:
    """The LIKE pattern that finds ``term`` anywhere in a text.

    Only ``%`` is taken literally; ``_`` stays a wildcard and a backslash keeps
    escaping the character after it.  Spark refuses a backslash before an
    ordinary character, where it means nothing, so such ones are dropped.
    """
    wrapped = "%" + term.replace("%", r"\%") + "%"
    return re.sub(r"(\\[%_\\])|\\(.)", r"\1\2", wrapped, flags=re.DOTALL)


def patterns_of(term: Column) -> Column:
    """``like_pattern`` of a column of terms."""
    wrapped = F.concat(F.lit("%"), F.replace(term, F.lit("%"), F.lit(r"\%")), F.lit("%"))
    return F.regexp_replace(wrapped, r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def matches(column: Column | str, term: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike(like_pattern(term))


def is_blank(column: Column) -> Column:
    return column.isNull() | column.rlike(r"(?U)\A\s*\z")


def _problems(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(message)) for failed, message in checks]))


def text_problems(text: Column) -> Column:
    """Array of the content rules a message text breaks; empty when it is fine."""
    not_question = ~text.endswith(QUESTION_MARK) | text.rlike(FORBIDDEN_CHARACTERS)
    return _problems(
        (is_blank(text), TEXT_BLANK),
        (F.length(text) > TEXT_LIMIT, TEXT_TOO_LONG),
        (~is_blank(text) & not_question, TEXT_NOT_QUESTION),
    )


def user_problems(username: Column, email: Column, display_name: Column) -> Column:
    """Array of the format rules a user row breaks; empty when it is fine."""

    def breaks(column: Column, pattern: str) -> Column:
        return ~F.coalesce(column.rlike(pattern), F.lit(False))

    return _problems(
        (breaks(email, EMAIL_FORMAT), EMAIL_INVALID),
        (is_blank(email), EMAIL_BLANK),
        (breaks(username, USERNAME_FORMAT), USERNAME_INVALID),
        (is_blank(username), USERNAME_BLANK),
        (F.length(username) > NAME_LIMIT, USERNAME_TOO_LONG),
        (is_blank(display_name), DISPLAY_NAME_BLANK),
        (F.length(display_name) > NAME_LIMIT, DISPLAY_NAME_TOO_LONG),
    )
