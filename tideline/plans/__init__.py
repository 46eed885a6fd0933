from tideline.plans.arrival import RN, arrival_index
from tideline.plans.count_windows import CountWindows, window_sums

__all__ = ["RN", "CountWindows", "arrival_index", "window_sums"]
