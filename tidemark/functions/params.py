"""Thresholds of the behavioural operators; the defaults are those of the production setting, fixed values all of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


# The defaults of the classes below.


@dataclass(frozen=True)
class FeatureParams:
    download_window_seconds: int = 120
    rapid_action_seconds: int = 7
    login_actions: tuple[str, ...] = ("Connexion", "Connexion SSO", "Connexion en tant que")
    logout_actions: tuple[str, ...] = ("Deconnexion", "SSO Disconnect")
    #: Words that make an action a download; empty: the table says itself which ones are, in ``is_download_action``.
    download_words: tuple[str, ...] = ("telecharg", "document", "certificat", "decompte", "wallet", "carte tp")


@dataclass(frozen=True)
class SessionParams:
    gap_seconds: int = 1200
    max_duration_seconds: int = 7200
    min_idle_seconds: int = 30
    grace_seconds: int = 60
    end_actions: tuple[str, ...] = ("Déconnexion", "Deconnexion", "DÃ©connexion", "SSO Disconnect")


@dataclass(frozen=True)
class RuleParams:
    unusual_hours: tuple[int, int] = (2, 4)
    allowed_first_actions: tuple[str, ...] = ("Connexion", "Connexion SSO", "Connexion en tant que", "Activation de compte")
    fail_types: tuple[str, ...] = ("BANKING_ACTIONS", "LOGGING_ACTIONS")
    fail_run: int = 3
    rapid_events: int = 3
    rapid_window_seconds: int = 2
    timeout_seconds: int = 1200
    download_spike: int = 10
    scraping_ping_pongs: int = 2


@dataclass(frozen=True)
class FusionParams:
    xgboost: float = 0.30
    lightgbm: float = 0.25
    transformer: float = 0.20
    tcn: float = 0.10
    rules: float = 0.15
    business_context: float = 0.0
    renormalize: bool = True
    medium: float = 35.0
    high: float = 60.0
    critical: float = 80.0
    alert: float = 60.0


@dataclass(frozen=True)
class ProfileParams:
    """``anomaly_at``: a session counts as anomalous from this score on. The production setting of 0.05 on a
    scale to 100 makes nearly every session one; 35.0 is the corrected value."""

    anomaly_at: float = 0.05
    medium_rate: float = 0.05
    high_rate: float = 0.20
    high_risk_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Params:
    features: FeatureParams = field(default_factory=FeatureParams)
    sessions: SessionParams = field(default_factory=SessionParams)
    rules: RuleParams = field(default_factory=RuleParams)
    fusion: FusionParams = field(default_factory=FusionParams)
    profile: ProfileParams = field(default_factory=ProfileParams)


def params_of(settings: dict, base: Params = Params()) -> Params:
    """``base`` with the settings of a configuration: part, field, value, as in ``{"sessions": {"gap_seconds": 600}}``.

    Lists become tuples. A part or field that is not known, or a value of another kind than its default, is an error.
    """
    new = {}
    for part, values in settings.items():
        old = getattr(base, part, None) if part in Params.__dataclass_fields__ else None
        if old is None:
            raise ValueError(f"unknown part of the settings: {part}")
        changed = {}
        for name, value in values.items():
            if name not in old.__dataclass_fields__:
                raise ValueError(f"unknown setting: {part}.{name}")
            value, default = tuple(value) if isinstance(value, list) else value, getattr(old, name)
            value = float(value) if isinstance(default, float) and type(value) is int else value
            if type(value) is not type(default):
                raise ValueError(f"{part}.{name} is to be {type(default).__name__}, not {type(value).__name__}")
            changed[name] = value
        new[part] = replace(old, **changed)
    return replace(base, **new)


#: For the generated events, whose users act a few times a day: wider windows, other action names.
GENERATED = Params(
    features=FeatureParams(43_200, 3_600, ("signup",), ("error",), ()),
    sessions=SessionParams(gap_seconds=86_400, max_duration_seconds=172_800),
    rules=RuleParams((2, 4), ("signup", "view"), ("error",), 2, 3, 43_200, 43_200, 3, 2),
    profile=ProfileParams(anomaly_at=35.0, medium_rate=0.05, high_rate=0.20),
)
