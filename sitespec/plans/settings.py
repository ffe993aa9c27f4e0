"""Argument checks, done on the driver before any job starts."""

from __future__ import annotations

# Pages per domain and whether endpoints are verified, by profile.
PROFILES = {"fast": (15, False), "balanced": (100, True), "deep": (500, True)}

# The leaf actions, the stages each one needs, and the action groups.
NEEDS = {
    "crawler": (),
    "html": ("crawler",),
    "assets": ("crawler",),
    "javascript": ("crawler",),
    "api": ("crawler", "javascript"),
    "routes": ("crawler", "api"),
    "explorer": ("crawler", "routes", "api"),
}
GROUPS = {
    "api_spec": ("crawler", "html", "javascript", "api"),
    "explorer_visual": ("crawler", "html", "routes", "explorer"),
    "cloning": ("crawler", "html", "assets"),
    "all_data": tuple(NEEDS),
}


def page_budget(profile: str, max_page: int | str) -> int:
    """Good pages per domain: the profile's number, or the caller's."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {sorted(PROFILES)}")
    if max_page == "all":
        return PROFILES[profile][0]
    if isinstance(max_page, bool) or not isinstance(max_page, int):
        raise ValueError("max_page must be an int or 'all'")
    if max_page <= 0:
        raise ValueError("max_page must be positive")
    return max_page


def stages(actions: str | list[str] | tuple[str, ...]) -> list[str]:
    """Sorted leaf actions that run for the requested ones, with what they need."""
    asked = [actions] if isinstance(actions, str) else actions
    if not isinstance(asked, (list, tuple)) or not asked:
        raise ValueError("actions must be a name or a non-empty list of names")
    todo = []
    for name in asked:
        if name not in NEEDS and name not in GROUPS:
            raise ValueError(f"unknown action {name!r}; known: {sorted({*NEEDS, *GROUPS})}")
        todo += GROUPS.get(name, (name,))
    done: set[str] = set()
    while todo:
        name = todo.pop()
        if name not in done:
            done.add(name)
            todo += NEEDS[name]
    return sorted(done)
