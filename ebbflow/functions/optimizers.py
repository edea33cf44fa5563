"""First-order update rules, one parameter at a time.

Each rule is written against ``ops`` (:mod:`ebbflow.plans.ops`), so that the
same formula runs on numbers and inside Catalyst. ``slots`` names what a
parameter remembers, with initial values; ``move(ops, g, w, s, t)`` returns what
is taken off the parameter and its new slots, for gradient ``g``, value ``w``,
slots ``s`` and step number ``t`` from 1. Formulas are the published ones.
"""

from __future__ import annotations

from dataclasses import dataclass

EPSILON = 1e-8


@dataclass(frozen=True)
class Rule:
    eta: float = 0.1

    @property
    def slots(self) -> dict[str, float]:
        return {}

    def move(self, ops, g, w, s, t):
        return self.eta * g, {}


@dataclass(frozen=True)
class Descent(Rule):
    """Plain gradient descent."""


@dataclass(frozen=True)
class Momentum(Rule):
    eta: float = 0.01
    rho: float = 0.9
    slots = {"v": 0.0}

    def move(self, ops, g, w, s, t):
        v = s["v"] * self.rho + g * self.eta
        return v, {"v": v}


@dataclass(frozen=True)
class Nesterov(Rule):
    eta: float = 0.001
    rho: float = 0.9
    slots = {"v": 0.0}

    def move(self, ops, g, w, s, t):
        taken = g * ((1 + self.rho) * self.eta) - s["v"] * self.rho**2
        return taken, {"v": s["v"] * self.rho - g * self.eta}


@dataclass(frozen=True)
class AdaGrad(Rule):
    eta: float = 0.1
    slots = {"a": EPSILON}

    def move(self, ops, g, w, s, t):
        a = s["a"] + g * g
        return g * self.eta / (ops.sqrt(a) + EPSILON), {"a": a}


@dataclass(frozen=True)
class RMSProp(Rule):
    eta: float = 0.001
    rho: float = 0.9
    slots = {"a": 0.0}

    def move(self, ops, g, w, s, t):
        a = s["a"] * self.rho + g * g * (1 - self.rho)
        return g * self.eta / (ops.sqrt(a) + EPSILON), {"a": a}


@dataclass(frozen=True)
class Adam(Rule):
    eta: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    slots = {"m": 0.0, "v": 0.0}

    def _moments(self, s, g):
        return s["m"] * self.beta1 + g * (1 - self.beta1), s["v"] * self.beta2 + g * g * (1 - self.beta2)

    def move(self, ops, g, w, s, t):
        m, v = self._moments(s, g)
        hat_m = m / (1 - ops.power(self.beta1, t))
        hat_v = v / (1 - ops.power(self.beta2, t))
        return hat_m / (ops.sqrt(hat_v) + EPSILON) * self.eta, {"m": m, "v": v}


@dataclass(frozen=True)
class AdamW(Adam):
    """Adam with decoupled weight decay."""

    decay: float = 0.0

    def move(self, ops, g, w, s, t):
        taken, slots = super().move(ops, g, w, s, t)
        return taken + w * (self.eta * self.decay), slots


@dataclass(frozen=True)
class RAdam(Adam):
    """Adam whose step is rectified while the variance of its scale is unknown."""

    def move(self, ops, g, w, s, t):
        m, v = self._moments(s, g)
        longest = 2 / (1 - self.beta2) - 1
        decayed = ops.power(self.beta2, t)
        length = longest - decayed * t * 2.0 / (1 - decayed)
        hat_m = m / (1 - ops.power(self.beta1, t))

        def rectified():
            scale = ops.sqrt((length - 4) * (length - 2) * longest / (length * ((longest - 4) * (longest - 2))))
            return hat_m * scale / (ops.sqrt(v / (1 - decayed)) + EPSILON) * self.eta

        return ops.where(length > 4, rectified, lambda: hat_m * self.eta), {"m": m, "v": v}


@dataclass(frozen=True)
class NAdam(Adam):
    """Adam that looks one step ahead."""

    def move(self, ops, g, w, s, t):
        m, v = self._moments(s, g)
        ahead = m * self.beta1 / (1 - ops.power(self.beta1, t + 1)) + g * (1 - self.beta1) / (1 - ops.power(self.beta1, t))
        return ahead / (ops.sqrt(v * self.beta2 / (1 - ops.power(self.beta2, t))) + EPSILON) * self.eta, {"m": m, "v": v}


@dataclass(frozen=True)
class AdaMax(Adam):
    """Adam by the infinity norm."""

    def move(self, ops, g, w, s, t):
        m = s["m"] * self.beta1 + g * (1 - self.beta1)
        v = ops.greatest(s["v"] * self.beta2, ops.absolute(g))
        return m / (1 - ops.power(self.beta1, t)) / (v + EPSILON) * self.eta, {"m": m, "v": v}


@dataclass(frozen=True)
class OAdam(Adam):
    """Optimistic Adam: twice the step less the step before."""

    beta1: float = 0.5
    beta2: float = 0.9
    slots = {"m": 0.0, "v": 0.0, "last": 0.0}

    def move(self, ops, g, w, s, t):
        step, moments = Adam.move(self, ops, g, w, s, t)
        return step * 2.0 - s["last"], {**moments, "last": step}


SGD = Descent


def default_optimizer() -> Rule:
    return Adam(0.001)
