"""Settings of one preparation run, and the values fixed by the data format."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

# These must stay as they are for results to be right.
COMMAND = "/kc"
UNASSIGNED = -1
CONVERSATION_GAP = timedelta(hours=8)
HISTORY_LENGTH = 10
INGEST_LIMIT = 10_000  # what one run fetched per channel; the limit is the caller's to set
FOLDS = 10
TEST_SHARE = 0.2

# Groups (channels, conversations, monologues) up to this many rows are handled by one
# task; larger ones are split over tasks. Rows at that point are narrow (tens of bytes).
MAX_GROUP_ROWS = 1_000_000


# Message ids rise with time at services that build them from milliseconds and 22 further bits. So many
# ids, a day's, share a folder of a stored table: what lands together is found in few folders.
ID_WIDTH = 86_400_000 << 22


@dataclass(frozen=True)
class ChatConfig:
    """Who the bot is, whom it speaks for, and how ids are named.

    ``names`` maps ids (users, channels and roles share one namespace) to display names.
    ``on_missing_name`` says what an author without a name does when its text is rendered:
    ``"error"`` fails the job, ``"id"`` shows the id, ``"drop"`` leaves the row out.
    """

    bot_id: int
    user_id: int
    names: dict[str, str] = field(default_factory=dict)
    command: str = COMMAND
    bot_label: str = "Assistant (bot)"
    gap: timedelta = CONVERSATION_GAP
    history: int = HISTORY_LENGTH
    instruction: str = "Answer the chat below as {name} would."
    on_missing_name: str = "error"
    on_missing_reply: str = "ignore"
    max_group_rows: int = MAX_GROUP_ROWS

    def __post_init__(self):
        if self.on_missing_name not in ("error", "id", "drop"):
            raise ValueError(f"on_missing_name: {self.on_missing_name!r}")
        if self.on_missing_reply not in ("ignore", "error"):
            raise ValueError(f"on_missing_reply: {self.on_missing_reply!r}")

    @property
    def user_name(self) -> str:
        """Name of the impersonated member; it must be listed."""
        return self.names[str(self.user_id)]

    @property
    def instruction_text(self) -> str:
        return self.instruction.format(name=self.user_name)
