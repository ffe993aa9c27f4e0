from sitespec.plans.inspect import Result, inspect

__all__ = ["Result", "inspect"]
