"""Front ends of the agent: a terminal and a chat, both without a library of their own; what sends messages is injected."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from sparkloom.functions.text import split_message
from sparkloom.plans.agent import Agent, Answer

RESET, HELP = "/reset", "/help"
GREETING = "Ask about the documents. /reset forgets the conversation."
SORRY = "That did not work. Please try again."


def reference_line(number: int, source: str, start: int | None, end: int | None) -> str:
    pages = "" if start is None else f" (p. {start})" if start == end else f" (pp. {start}-{end})"
    return f"[{number}] {source}{pages}"


def answer_text(answer: Answer) -> str:
    """An answer with its references, numbered, as plain text."""
    lines = [reference_line(n, *place) for n, place in enumerate(answer.references, 1)]
    parts = [answer.text.strip(), "(partial answer)" if answer.status == "partial" else "", "Sources:\n" + "\n".join(lines) if lines else ""]
    return "\n\n".join(p for p in parts if p)


def terminal(agent: Agent, lines: Iterable[str], write: Callable[[str], None], thread: str = "terminal") -> int:
    """Answers line by line until the lines end (X18); returns how many questions were answered."""
    answered = 0
    for line in lines:
        text = line.strip()
        if not text:
            continue
        if text == RESET:
            agent.reset(thread)
            write("Forgotten.")
            continue
        try:
            write(answer_text(agent.ask(text, thread)))
            answered += 1
        except (RuntimeError, ValueError) as e:
            write(f"{SORRY} ({e})")
    return answered


@dataclass
class Chat:
    """Messages of a chat service (X10): only chats on the list are answered, one question of a thread at a time, with a sign that the
    answer is being worked on. ``send(chat, text)`` and ``typing(chat)`` are the service's."""

    agent: Agent
    send: Callable[[int, str], None]
    typing: Callable[[int], None]
    allowed: frozenset[int] = frozenset()
    every: float = 4.0
    locks: dict[str, threading.Lock] = field(default_factory=dict)

    @staticmethod
    def thread(chat: int, user: int, group: bool) -> str:
        return f"chat:{chat}:user:{user}" if group else f"chat:{chat}"

    def handle(self, chat: int, user: int, text: str, group: bool = False) -> bool:
        """Answers one message; False where the chat is not on the list, which is not told."""
        if chat not in self.allowed:
            return False
        text, thread = text.strip(), self.thread(chat, user, group)
        if not text or text == HELP:
            self.send(chat, GREETING)
            return True
        if text == RESET:
            self.agent.reset(thread)
            self.send(chat, "Forgotten.")
            return True
        with self.locks.setdefault(thread, threading.Lock()):
            done = threading.Event()

            def sign() -> None:
                while not done.is_set():
                    self.typing(chat)
                    done.wait(self.every)

            worker = threading.Thread(target=sign, daemon=True)
            worker.start()
            try:
                reply = answer_text(self.agent.ask(text, thread))
            except (RuntimeError, ValueError):
                reply = SORRY
            finally:
                done.set()
                worker.join()
            for part in split_message(reply):
                self.send(chat, part)
        return True
