"""A conversation held on the driver, question by question, with a memory that later prompts see.

Batches of questions belong in scriptorium.operators.answering; this is for a person, or for questions that must follow one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from scriptorium.errors import GenerationError, RetrievalError
from scriptorium.operators.answering import CONTEXT_HEAD, HISTORY, HISTORY_HEAD, NO_CONTEXT, QUESTION_HEAD


@dataclass(frozen=True)
class Passage:
    """A piece of context; the defaults are those of a context that a comparison brings along."""

    text: str
    source: str = "comparison"
    page: str = "?"
    section: str = "comparison"
    score: float = 1.0
    confidence: str = "High"


@dataclass
class Conversation:
    """complete: a prompt -> the answer's pieces, one after the other."""

    complete: Callable[[str], Iterator[str]]
    turns: list[tuple[str, str]] = field(default_factory=list)

    def prompt(self, question: str, passages: list[Passage]) -> str:
        if not question.strip():
            raise RetrievalError("a question is empty")
        lines = [f"{'User' if who == 'user' else 'Assistant'}: {text}" for who, text in self.turns[-HISTORY:]]
        before = HISTORY_HEAD + "\n".join(lines) + "\n\n" if lines else ""
        blocks = [f"[{k}] Source: {p.source} | Page: {p.page} | Section: {p.section} | Confidence: {p.confidence}\n{p.text}\n" for k, p in enumerate(passages, 1)]
        return before + (CONTEXT_HEAD + "\n".join(blocks) if blocks else NO_CONTEXT) + QUESTION_HEAD + question

    def stream(self, question: str, passages: list[Passage]) -> Iterator[str]:
        """The answer piece by piece. Question and answer are remembered once the last piece was taken, so not if a reader stops."""
        said = []
        try:
            for piece in self.complete(self.prompt(question, passages)):
                said.append(piece)
                yield piece
        except (RetrievalError, GeneratorExit):
            raise
        except Exception as e:
            raise GenerationError(f"no answer: {e}") from e
        self.turns += [("user", question), ("assistant", "".join(said))]

    def ask(self, question: str, passages: list[Passage]) -> str:
        return "".join(self.stream(question, passages))
