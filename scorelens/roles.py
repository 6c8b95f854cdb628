"""Which columns of an application table are numeric, categorical and the target."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    missing: tuple[str, ...] = field(default=())

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def existing(self, df: DataFrame) -> "Roles":
        """Keep the configured columns that ``df`` has; list the others in ``missing``."""
        have = set(df.columns)
        wanted = [*self.features, *([self.target] if self.target else [])]
        return Roles(
            tuple(c for c in self.numeric if c in have),
            tuple(c for c in self.categorical if c in have),
            self.target if self.target in have else None,
            tuple(c for c in wanted if c not in have),
        )


# The column roles of the German credit application file.
GERMAN_CREDIT = Roles(
    numeric=(
        "duration",
        "credit_amount",
        "installment_commitment",
        "residence_since",
        "age",
        "existing_credits",
        "num_dependents",
    ),
    categorical=(
        "checking_status",
        "credit_history",
        "purpose",
        "savings_status",
        "employment",
        "personal_status",
        "other_parties",
        "property_magnitude",
        "other_payment_plans",
        "housing",
        "job",
        "own_telephone",
        "foreign_worker",
    ),
    target="default",
)
