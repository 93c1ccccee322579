"""Settings of the stages, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("grad_ascent", "grad_diff", "KL", "noisy_grad_diff", "po", "dpo", "npo")
FORGET_MODES = ("same_firstname", "different_firstname", "n_per_firstname", "random", "random_combination")
RETAIN_MODES = ("all_except_forget", "same_firstname", "same_attr", "same_firstname_same_attr")
QUANTISATIONS = ("none", "4bit", "8bit")
RECOVERIES = ("flip", "beam", "grad")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value}")


@dataclass(frozen=True)
class FineTune:
    learning_rate: float = 1e-4
    weight_decay: float = 0.01
    epochs: int = 30
    rank: int = 256
    dropout: float = 0.05
    accumulation: int = 40

    @property
    def alpha(self) -> int:
        return 2 * self.rank

    def steps(self, samples: int, batch: int) -> int:
        """Batches of one pass, the last one counted though it be short."""
        return -(-samples // batch)


@dataclass(frozen=True)
class Unlearn(FineTune):
    method: str = "grad_diff"
    reg_weight: float = 1.0
    beta: float = 0.1
    noise_std: float = 0.0
    clip_norm: float = 1.0

    def __post_init__(self) -> None:
        _one_of("method", self.method, METHODS)

    @property
    def needs_retain(self) -> bool:
        return self.method != "grad_ascent"

    @property
    def needs_refusals(self) -> bool:
        return self.method in ("dpo", "po")


@dataclass(frozen=True)
class Pretrain:
    """The defaults of a pretraining run."""

    learning_rate: float = 5e-5
    weight_decay: float = 0.01
    epochs: int = 5
    batch: int = 8
    accumulation: int = 1
    block_size: int = 128
    warmup_ratio: float = 0.03
    validation_percent: float = 5.0
    save_every: int = 5
    save_limit: int = 100
    seed: int = 42

    def __post_init__(self) -> None:
        if self.block_size < 1 or self.save_every < 1 or self.save_limit < 1:
            raise ValueError("block_size, save_every and save_limit must be 1 at least")
        if not 0 <= self.validation_percent < 100:
            raise ValueError("validation_percent must be from 0 to 100")


@dataclass(frozen=True)
class Split:
    forget_mode: str = "random"
    retain_mode: str | None = None
    num_profiles: int = 1
    max_per_first_name: int = 10
    attributes: tuple[str, ...] | None = None
    seed: str = "split"

    def __post_init__(self) -> None:
        _one_of("forget_mode", self.forget_mode, FORGET_MODES)
        if self.retain_mode is not None:
            _one_of("retain_mode", self.retain_mode, RETAIN_MODES)

    @property
    def retain_modes(self) -> tuple[str, ...]:
        return (self.retain_mode,) if self.retain_mode else ("all_except_forget", "same_attr", "same_firstname_same_attr")


@dataclass(frozen=True)
class Evaluate:
    batch: int = 5
    max_new_tokens: int = 100
    quantisation: str = "none"
    judge_base: bool = False
    judge_full: bool = True
    text_metrics: bool = False

    def __post_init__(self) -> None:
        _one_of("quantisation", self.quantisation, QUANTISATIONS)


@dataclass(frozen=True)
class Recover:
    kind: str = "flip"
    mode: str = "greedy"
    flip: bool = True
    loss: str = "ce"
    beta: float = 1.0
    beams: int = 1
    candidates: int = 1
    entropy: bool = False

    @classmethod
    def legacy(cls, flip_logit: bool, **settings) -> Recover:
        """Settings by the older switch, which stands for the flip kind."""
        return cls(**(settings | {"kind": "flip"} if flip_logit else settings))

    def __post_init__(self) -> None:
        _one_of("kind", self.kind, RECOVERIES)
        _one_of("mode", self.mode, ("greedy", "oracle"))
        _one_of("loss", self.loss, ("ce", "npo"))
