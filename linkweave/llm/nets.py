"""What the two recurrent networks share: the logistic function and the Adam step."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Adam:
    """Adam over a dictionary of arrays; the rate falls to zero over the second half of ``steps``."""

    def __init__(self, params: dict[str, np.ndarray], steps: int, rate: float):
        self.params, self.steps, self.rate, self.done = params, steps, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.done += 1
        t = self.done
        rate = self.rate * min(1.0, 2 * (1 - t / (self.steps + 1)))
        for k, g in grads.items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.99 * self.square[k] + 0.01 * g * g
            mean, square = self.mean[k] / (1 - 0.9**t), self.square[k] / (1 - 0.99**t)
            self.params[k] -= (rate * mean / (np.sqrt(square) + 1e-6)).astype(np.float32)
