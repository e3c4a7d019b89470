"""Sorties flown one by one, and stop plans made stop by stop: what the folds of the library are held against."""

import math

from tidemesh import defaults as D
from tidemesh.functions.flight import drops_per_load


def _against(a: tuple, b: tuple, wind: float, wind_from: float) -> float:
    if a == b:
        return 0.0
    heading = math.degrees(math.atan2(b[0] - a[0], a[1] - b[1])) % 360
    return max(0.0, wind * math.cos(math.radians(wind_from - heading)))


def _leg(a: tuple, b: tuple, kg: float, wind: float, wind_from: float, scale: float) -> tuple[float, float]:
    metres = math.dist(a, b) * scale
    return metres, metres / D.SPEED_MPS / 60 * (1 + kg * D.PAYLOAD_FACTOR + _against(a, b, wind, wind_from) * D.WIND_FACTOR) / D.ENDURANCE_MIN


def sortie_cost(home: tuple, drops: list[tuple], wind: float, wind_from: float, scale: float, reserve: float = D.RESERVE) -> tuple[float, float, float, int]:
    """(cost, hours, worst sortie, unserved) of serving drops from home; cost is hours plus battery of all sorties.

    Drops are flown in nearest-neighbour order. A sortie takes as many of the next ones as leave the reserve; a drop
    that fails alone counts as unserved, at two of its legs.
    """
    left, at, order = list(drops), home, []
    while left:
        at = min(left, key=lambda p: (p[0] - at[0]) ** 2 + (p[1] - at[1]) ** 2)  # the first of equals
        left.remove(at)
        order.append(at)

    def closed(part: list[tuple]) -> tuple[float, float]:
        metres = battery = 0.0
        for i, (a, b) in enumerate(zip([home, *part], [*part, home], strict=True)):
            m, used = _leg(a, b, (len(part) - i) * D.PER_DROP_KG, wind, wind_from, scale)
            metres, battery = metres + m, battery + used
        return metres, battery

    total, battery, worst, unserved, k = 0.0, 0.0, 0.0, 0, 0
    while k < len(order):
        best = None
        for n in range(1, min(drops_per_load(), len(order) - k) + 1):
            trial = closed(order[k : k + n])
            if trial[1] > 1 - reserve:
                break
            best = n, *trial
        if best is None:
            metres, used = closed(order[k : k + 1])
            best, unserved = (1, metres, used), unserved + 1
        k, total, battery, worst = k + best[0], total + best[1], battery + best[2], max(worst, best[2])
    hours = total / D.SPEED_MPS / 3600
    return hours + battery, hours, worst, unserved


def _drain(metres: float, kg: float, wind: float) -> float:
    return max(0.0, metres) / D.SPEED_MPS / 60 * (1 + kg * D.PAYLOAD_FACTOR + wind * D.WIND_FACTOR) / D.ENDURANCE_MIN


class Base:
    """One base's stops and what flying to them takes, sortie by sortie; known maps (from, to) to routed metres."""

    def __init__(self, home: tuple, stops: list[tuple], wind: float, first_hour: float, scale: float, capacity: float = D.CAPACITY_KG, known: dict | None = None):
        """stops are (drop_id, (x, y), [(from, to), ...]) in the order of visits; wind is in m/s."""
        self.home, self.stops, self.wind, self.first_hour, self.scale, self.known = home, stops, wind, first_hour, scale, known or {}
        self.reserve, self.per_drop, self.most = D.RESERVE, D.PER_DROP_KG, max(1, int((capacity + 1e-9) // D.PER_DROP_KG))

    def metres(self, a: tuple, b: tuple) -> float:
        return self.known.get((a, b), math.dist(a, b) * self.scale)

    def wet(self, k: int, hours: float) -> bool:
        return any(a <= hours < b for a, b in self.stops[k][2])

    def order(self) -> list[int]:
        """Stops whose estimated arrival finds them flooded come first; before the first frame only hour 0 counts."""
        at, clock, wet, dry = self.home, 0.0, [], []
        for k, (_, place, _) in enumerate(self.stops):
            clock += math.dist(at, place) * self.scale / D.SPEED_MPS / 3600
            at = place
            (wet if self.wet(k, clock if clock >= self.first_hour else 0.0) else dry).append(k)
        return wet + dry

    def fly(self, sortie: list[int], clock: float) -> tuple[float, float, float]:
        """(battery, arrival at the last stop, return) of a closed sortie that starts at clock, in hours."""
        at, used = self.home, 0.0
        for n, k in enumerate(sortie):
            leg = self.metres(at, self.stops[k][1])
            used += _drain(leg, self.per_drop * (len(sortie) - n), self.wind)
            clock += leg / D.SPEED_MPS / 3600
            at = self.stops[k][1]
        back = self.metres(at, self.home)
        return used + _drain(back, 0.0, self.wind), clock, clock + back / D.SPEED_MPS / 3600

    def plan(self) -> tuple[list[tuple], list[tuple]]:
        """(sorties, rejects): (stops, battery left after, recharged before), and (stop, reason)."""
        sorties, rejects = [], []
        battery, clock, fresh, open_stops = 1.0, 0.0, False, []

        def close() -> None:
            nonlocal battery, clock, fresh, open_stops
            if open_stops:
                used, _, clock = self.fly(open_stops, clock)
                battery -= used
                sorties.append((open_stops, battery, fresh))
                open_stops, fresh = [], False

        def recharge() -> None:
            nonlocal battery, fresh
            battery, fresh = 1.0, True

        for k in self.order():
            if len(open_stops) == self.most:
                close()
                recharge()
            used, arrival, _ = self.fly([*open_stops, k], clock)
            if battery - used < self.reserve:
                if 1.0 - self.fly([k], clock)[0] < self.reserve:
                    rejects.append((k, "battery"))
                    continue
                if open_stops:
                    close()
                    recharge()
                elif battery < 1.0 - 1e-9:
                    recharge()
                used, arrival, _ = self.fly([k], clock)
            if self.wet(k, arrival):
                rejects.append((k, "flooded at arrival"))
            else:
                open_stops = [*open_stops, k]
        close()
        return sorties, rejects

    def points(self) -> list[tuple]:
        """The route: (x, y, kind, drop_id, battery, reason)."""
        sorties, rejects = self.plan()
        points = [(*self.home, "home", None, 1.0, None)]
        for stops, left, fresh in sorties:
            if fresh:
                points[-1] = (*points[-1][:2], "reload", *points[-1][3:])
                points.append((*self.home, "via", None, 1.0, None))
            points += [(*self.stops[k][1], "drop", self.stops[k][0], None, None) for k in stops]
            points.append((*self.home, "home", None, left, None))
        return points + [(*self.stops[k][1], "reject", self.stops[k][0], None, why) for k, why in rejects]


def settled(home: tuple, stops: list[tuple], wind: float, first_hour: float, scale: float, legs_of, most: int = 6) -> tuple[list[tuple], str, int]:
    """(points, outcome, rounds) of planning and routing in turns; legs_of maps route points to [(from, to, metres)]."""
    known: dict = {}
    points = Base(home, stops, wind, first_hour, scale).points()
    on_route = lambda ps: [p[:3] for p in ps if p[2] != "reject"]
    history, cap = [on_route(points)], min(most, len(stops) + 2)
    for k in range(1, cap + 1):
        known |= {(a, b): metres for a, b, metres in legs_of([p[:2] for p in on_route(points)])}
        points = Base(home, stops, wind, first_hour, scale, known=known).points()
        if on_route(points) in history:
            return points, "converged" if on_route(points) == history[-1] else "cycle", k
        history.append(on_route(points))
    return points, "iteration_cap", cap
