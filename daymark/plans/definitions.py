"""The five entities' features, made from blocks that repeat for each window."""

from __future__ import annotations

from .language import Features, parse

KEYS = {"user": ("user_id",), "merchant": ("merchant_id",), "coupon": ("coupon_id",), "user_merchant": ("user_id", "merchant_id"), "user_coupon": ("user_id", "coupon_id")}
PAST = ("recent", "longago", "history")
RECEIVED, USED, BOUGHT = "offline_receive_coupon", "offline_buy_with_coupon", "offline_buy_without_coupon"


def paths(window: str, *tails: str) -> list[str]:
    return [f"{window}.{t}" for t in tails]


def measured(kind: str, value: str, *aggregates: str) -> list[str]:
    return [f"{kind}.{value}.{a}" for a in aggregates or ("min", "max", "mean")]


def ratio(window: str, left: str, right: str, sign: str = "/") -> str:
    return f"{window}({left} {sign} {right})"


def counts(*kinds: str) -> list[str]:
    return [f"{k}.count" for k in kinds]


MEAN_FIRST = ("mean", "min", "max")


def user_text() -> str:
    out = []
    for w in PAST:
        out += [*paths(w, *counts(RECEIVED, USED, BOUGHT)), ratio(w, f"{USED}.count", f"{RECEIVED}.count")]
        out += [*paths(w, f"{RECEIVED}.man200.count", f"{USED}.man200.count"), ratio(w, f"{USED}.man200.count", f"{RECEIVED}.man200.count"), ratio(w, f"{USED}.man200.count", f"{USED}.count")]
        out += paths(w, *measured(RECEIVED, "discount_rate", *MEAN_FIRST), *measured(USED, "discount_rate", *MEAN_FIRST), *measured(USED, "timedelta"))
        for u in ("unique_merchant", "unique_coupon"):
            out += [*paths(w, f"offline.{u}.count", f"{USED}.{u}.count"), ratio(w, f"{USED}.{u}.count", f"offline.{u}.count")]
        out += [ratio(w, f"{USED}.count", f"{USED}.unique_merchant.count")]
        out += paths(w, *measured(USED, "distance", *MEAN_FIRST), *measured(BOUGHT, "distance", *MEAN_FIRST))
    out += paths("today", *counts(RECEIVED))
    out += paths("future", f"{RECEIVED}.count", f"{RECEIVED}.unique_merchant.count", f"{RECEIVED}.unique_coupon.count", f"{RECEIVED}.deltanow.min")
    for w in ("history", "recent"):
        out += paths(w, *counts("online_click", "online_receive_coupon", "online_buy_with_coupon", "online_buy_without_coupon"))
        out += [ratio(w, "online_receive_coupon.count", "online_click.count"), ratio(w, "online_buy_with_coupon.count", "online_receive_coupon.count")]
    return "\n".join(out)


def merchant_text() -> str:
    out = []
    for w in PAST:
        out += [*paths(w, *counts(RECEIVED, USED, BOUGHT)), ratio(w, f"{USED}.count", f"{RECEIVED}.count")]
        out += paths(w, *(f"{k}.unique_user.count" for k in ("offline", RECEIVED)), *(f"{k}.{u}.count" for k in (USED, BOUGHT) for u in ("unique_user", "unique_hotuser")))
        out += [ratio(w, f"{USED}.unique_user.count", f"{RECEIVED}.unique_user.count"), ratio(w, f"{USED}.count", f"{USED}.unique_user.count")]
        out += paths(w, *(p for k, v in ((RECEIVED, "discount_rate"), (USED, "discount_rate"), (USED, "distance"), (BOUGHT, "distance"), (USED, "timedelta")) for p in measured(k, v)))
        out += paths(w, "offline.unique_coupon.count", "offline.unique_hotcoupon.count")
    for w in ("today", "future"):
        out += paths(w, f"{RECEIVED}.count", f"{RECEIVED}.unique_user.count", f"{RECEIVED}.unique_coupon.count")
    return "\n".join(out)


#: The order of the past windows where a pair or a coupon is the key.
NEAR_FIRST = ("history", "recent", "longago")


def user_merchant_text() -> str:
    out = paths("future", f"{RECEIVED}.deltanow.min", f"{RECEIVED}.count") + paths("today", f"{RECEIVED}.count")
    for w in NEAR_FIRST:
        out += paths(w, *counts(RECEIVED, USED, BOUGHT))
        out += [ratio(w, f"{RECEIVED}.count", f"{USED}.count", "-"), ratio(w, f"{USED}.count", f"{RECEIVED}.count")]
    return "\n".join(out)


def coupon_text() -> str:
    out = paths("future", f"{RECEIVED}.count") + paths("today", f"{RECEIVED}.count")
    for w in NEAR_FIRST:
        for k in (RECEIVED, USED):
            out += paths(w, f"{k}.count", f"{k}.unique_user.count", *[f"{USED}.timedelta.mean"] * (k == USED), *measured(k, "distance", *MEAN_FIRST))
        out += [ratio(w, f"{USED}.count", f"{RECEIVED}.count")]
    return "\n".join(out)


def user_coupon_text() -> str:
    return "\n".join([f"future.{RECEIVED}.count", f"today.{RECEIVED}.count", f"future.{RECEIVED}.deltanow.min"])


TEXTS = {"user": user_text, "merchant": merchant_text, "coupon": coupon_text, "user_merchant": user_merchant_text, "user_coupon": user_coupon_text}


def features(entity: str) -> Features:
    """The features of user, merchant, coupon, user_merchant or user_coupon."""
    return parse(TEXTS[entity]())
