"""Which column of a transaction table plays which role."""

from __future__ import annotations

from dataclasses import dataclass


# Identity columns that hold text.
IDENTITY_TEXT_FIELDS = (
    "id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30",
    "id_31", "id_33", "id_34", "id_35", "id_36", "id_37", "id_38",
)

# Names of the derived columns, in the order of the feature contract.
AMOUNT_FEATURES = ("log_transaction_amount", "transaction_amount_capped", "amount_decimal")
TIME_FEATURES = (
    "transaction_day",
    "transaction_week",
    "transaction_hour",
    "transaction_day_of_week_proxy",
    "transaction_age_days",
    "is_night_transaction",
)
MISSING_FEATURES = (
    "selected_missing_count",
    "selected_missing_ratio",
    "identity_missing_count",
    "identity_missing_ratio",
)
FLAG_FEATURES = (
    "has_identity",
    "has_device_info",
    "has_p_email",
    "has_r_email",
    "has_distance",
    "has_address",
    "same_email_domain",
    "high_amount_flag",
    "amount_outlier_flag",
    "distance_outlier_flag",
)
CARD_HISTORY = (
    "prior_card_transaction_count",
    "prior_card_amount_sum",
    "prior_card_avg_amount",
    "prior_card_amount_stddev",
    "time_since_previous_card_transaction",
)
EMAIL_HISTORY = (
    "prior_email_transaction_count",
    "prior_email_amount_sum",
    "prior_email_avg_amount",
)
DEVICE_HISTORY = (
    "prior_device_transaction_count",
    "prior_device_amount_sum",
    "prior_device_avg_amount",
)
RATIO_FEATURES = ("amount_ratio_to_card_mean", "amount_deviation_from_card_mean")


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of a transaction table joined with its side table.

    ``amount_scale`` is the number of decimals that amounts usually carry: sums
    are then taken over 64-bit whole units, else over decimals of nine places. Neither depends on the order of rows.
    """

    id: str
    time: str
    amount: str
    label: str
    product: str
    card_parts: tuple[str, ...]
    card_brand: str
    card_type: str
    payer_email: str
    receiver_email: str
    device_type: str
    device_info: str
    distances: tuple[str, ...]
    addresses: tuple[str, ...]
    normalised: tuple[str, ...]
    watched: tuple[str, ...]
    identity_prefix: str = "id_"
    extra_numeric: tuple[str, ...] = ()
    extra_categorical: tuple[str, ...] = ()
    amount_scale: int = 2

    @property
    def numeric_features(self) -> tuple[str, ...]:
        return (
            self.amount,
            *AMOUNT_FEATURES,
            self.time,
            *TIME_FEATURES,
            *MISSING_FEATURES,
            *FLAG_FEATURES,
            *self.distances,
            *self.extra_numeric,
            *CARD_HISTORY,
            *EMAIL_HISTORY,
            *DEVICE_HISTORY,
            *RATIO_FEATURES,
        )

    @property
    def categorical_features(self) -> tuple[str, ...]:
        return (
            self.product,
            self.card_brand,
            self.card_type,
            self.device_type,
            "device_family",
            *self.extra_categorical,
            "amount_band",
        )

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric_features + self.categorical_features


# Column names of the wide card-payment layout (394 + 41 columns).
CARD_PAYMENTS = TableSpec(
    id="TransactionID",
    time="TransactionDT",
    amount="TransactionAmt",
    label="isFraud",
    product="ProductCD",
    card_parts=("card1", "card2", "card3", "card5"),
    card_brand="card4",
    card_type="card6",
    payer_email="P_emaildomain",
    receiver_email="R_emaildomain",
    device_type="DeviceType",
    device_info="DeviceInfo",
    distances=("dist1", "dist2"),
    addresses=("addr1", "addr2"),
    normalised=(
        "ProductCD",
        "card1", "card2", "card3", "card4", "card5", "card6",
        "addr1",
        "addr2",
        "P_emaildomain",
        "R_emaildomain",
        "DeviceType",
        "DeviceInfo",
        "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9",
        *IDENTITY_TEXT_FIELDS,
    ),
    watched=(
        "TransactionAmt",
        "ProductCD",
        "card1", "card2", "card3", "card4", "card5", "card6",
        "addr1",
        "addr2",
        "P_emaildomain",
        "R_emaildomain",
        "DeviceType",
        "DeviceInfo",
        "dist1",
        "dist2",
        "C1", "C2", "C3", "D1", "D2", "D3",
    ),
    extra_numeric=(
        "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9", "C10", "C11", "C12", "C13", "C14",
        "D1", "D2", "D3", "D4", "D5", "D10", "D15",
    ),
    extra_categorical=("M4",),
    amount_scale=3,
)
