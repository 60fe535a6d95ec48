"""What is said when no recommendation is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MESSAGES = {
    "R001_SOURCE_PARSE_FAILED": "We can't refactor this snippet because it does not parse as valid Python 3.12. Fix the syntax error and try again.",
    "R002_SOURCE_TOO_LONG": "We can't refactor this snippet because it exceeds the 512-token chunk size we trained on. Try a smaller selection.",
    "R003_SOURCE_EMPTY": "We can't refactor this snippet because it is empty after normalization. Make sure the selection contains executable Python.",
    "R004_NO_CANDIDATE_PASSED_ACCEPTANCE": "We could not find a candidate that satisfies the selected intent's acceptance rule. Try a different intent or a different snippet.",
    "R005_CONFIDENCE_BELOW_THRESHOLD": "The top candidate's similarity was below the configured refusal threshold (τ=0.55). We are returning no recommendation rather than a low-confidence one.",
    "R006_SAFETY_CHECKER_REJECTED_ALL": "Every candidate was rejected by a safety checker (side-effect change, exception-contract change, public-API change, or async/sync boundary change).",
    "R007_INTENT_UNSUPPORTED_ON_SOURCE": "The selected intent's acceptance rule cannot apply to this snippet (for example, comprehension-rewrite on a loop containing break or continue).",
}


def message(code: Column) -> Column:
    """The message of a refusal code; null of null, and an error for a code outside the closed set."""
    known = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(known[code], F.raise_error(F.concat(F.lit("unknown refusal code: "), code)).cast("string")))
