"""Round-based federated learning as DataFrame steps.

Participants and their metadata are tables; each decision of a round is a query over them.  The loop
on the driver only moves from one written table to the next.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import MissingContext, NotEnough
from graphloom.operators.joins import nearest, require
from graphloom.operators.sampling import weighted_sample
from graphloom.operators.vectors import federated_average, weighted_mean
from graphloom.plans.storage import table


class Algorithm(ABC):
    """The hooks of a federated algorithm; each takes and returns DataFrames."""

    @abstractmethod
    def should_stop(self, round_no: int) -> bool: ...

    @abstractmethod
    def map_nodes(self, fogs: DataFrame, clients: DataFrame) -> DataFrame:
        """aggregator and client of each client."""

    @abstractmethod
    def select_train(self, clients: DataFrame, sizes: DataFrame) -> DataFrame:
        """The clients (node) that train in this round, from aggregator and node of all."""

    @abstractmethod
    def aggregate_train(self, updates: DataFrame) -> DataFrame:
        """group, weights and size from updates (group, weights, size)."""

    @abstractmethod
    def should_aggregate_globally(self, round_no: int) -> bool: ...

    @abstractmethod
    def select_global(self, workload: DataFrame) -> str | None:
        """The aggregator that averages all others' weights; None for the cloud."""

    @abstractmethod
    def aggregate_eval(self, accuracies: DataFrame) -> DataFrame:
        """One row with accuracy from value and size of each client."""

    def select_eval(self, clients: DataFrame) -> DataFrame:
        return clients

    def depends_on(self) -> Sequence[str]:
        return ("DatasetSize", "Accuracy", "Aggregation", "ModelWeightsUpdate")


@dataclass(frozen=True)
class FedAvg(Algorithm):
    """Weighted averaging; numbers out of range are brought into it."""

    rounds: int = 10
    global_period: int = 1
    min_aggregators: int = 1
    min_clients: int = 1
    min_clients_per_aggregator: int = 1
    client_fraction: float = 1.0
    max_workload: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("rounds", "global_period", "min_aggregators", "min_clients", "min_clients_per_aggregator"):
            object.__setattr__(self, name, max(1, int(getattr(self, name))))
        object.__setattr__(self, "client_fraction", min(1.0, max(0.0, float(self.client_fraction))))

    def should_stop(self, round_no: int) -> bool:
        return round_no >= self.rounds

    def should_aggregate_globally(self, round_no: int) -> bool:
        return (round_no + 1) % self.global_period == 0

    def map_nodes(self, fogs: DataFrame, clients: DataFrame) -> DataFrame:
        """Each client with its nearest aggregator (node, x, y on both sides); aggregators without clients are left out."""
        n_fogs, n_clients = fogs.count(), clients.count()
        if n_fogs < self.min_aggregators:
            raise NotEnough("aggregators", n_fogs, self.min_aggregators)
        if n_clients < self.min_clients:
            raise NotEnough("clients", n_clients, self.min_clients)
        near = nearest(clients, "node", ["x", "y"], fogs.withColumnRenamed("node", "aggregator"), "aggregator", ["x", "y"])
        assigned = near.select("aggregator", F.col("node").alias("client"))
        fewest = assigned.groupBy("aggregator").count().agg(F.min("count")).first()[0]
        if fewest is not None and fewest < self.min_clients_per_aggregator:
            raise NotEnough("clients of an aggregator", fewest, self.min_clients_per_aggregator)
        return assigned

    def select_train(self, clients: DataFrame, sizes: DataFrame) -> DataFrame:
        """A sample of each aggregator's clients, weighted by dataset size; clients without a size are never drawn.

        Clients without an aggregator column are drawn from as one.
        """
        latest = sizes.groupBy("node").agg(F.max("value").alias("value"))
        group = [c for c in clients.columns if c == "aggregator"]
        known = clients.join(latest, "node", "left").select("node", *group, F.coalesce("value", F.lit(0)).alias("value"))
        least = self.min_clients_per_aggregator if group else self.min_clients
        return weighted_sample(known, "node", "value", self.client_fraction, least, self.seed, group).select("node")

    def aggregate_train(self, updates: DataFrame) -> DataFrame:
        return federated_average(updates, "weights", "size", ["group"])

    def select_global(self, workload: DataFrame) -> str | None:
        within = workload.where(F.lit(True) if self.max_workload is None else F.col("total") <= self.max_workload)
        return within.agg(F.min_by("node", F.struct("total", "node"))).first()[0]

    def aggregate_eval(self, accuracies: DataFrame) -> DataFrame:
        return accuracies.agg(weighted_mean(F.col("value"), F.col("size")).alias("accuracy"))


ALGORITHMS: dict[str, Callable[..., Algorithm]] = {"fedavg": FedAvg}


def create_algorithm(name: str, parameters: Mapping[str, object]) -> Algorithm | None:
    """An algorithm by name; None if there is none, an error if the parameters do not fit."""
    make = ALGORITHMS.get(name)
    return None if make is None else make(**parameters)


def node_counts(mapping: DataFrame) -> DataFrame:
    """n_aggregators, n_clients and n_nodes of an assignment."""
    return mapping.agg(F.countDistinct("aggregator").alias("n_aggregators"), F.count(F.lit(1)).alias("n_clients")).select(
        "*", (F.col("n_aggregators") + F.col("n_clients")).alias("n_nodes")
    )


def model_sizes(nodes: DataFrame, dataset_sizes: DataFrame, aggregations: DataFrame) -> DataFrame:
    """node and size: a node's own dataset, plus the datasets of the nodes it has aggregated; a node without any is an error."""
    own = dataset_sizes.select("node", "value")
    via = aggregations.select(F.col("node").alias("_by"), F.explode("on_node").alias("node")).join(own, "node").select(F.col("_by").alias("node"), "value")
    sums = own.unionByName(via).groupBy("node").agg(F.sum("value").alias("size"))
    return require(nodes.select("node").join(sums, "node", "left"), "size", "node")


def workload(aggregations: DataFrame, updates: DataFrame, task: str, round_no: int) -> DataFrame:
    """node and total bytes each aggregator has taken in in a round."""
    own = aggregations.where((F.col("task") == task) & (F.col("round") == round_no)).select("node", F.explode("on_node").alias("from_node"))
    sent = updates.where((F.col("task") == task) & (F.col("round") == round_no)).select("node", "from_node", "total_size")
    return own.join(sent, ["node", "from_node"]).groupBy("node").agg(F.sum("total_size").alias("total"))


def all_answered(answers: DataFrame, expected: int) -> DataFrame:
    """answers, if every participant gave one in time; else an error."""
    got = answers.count()
    if got < expected:
        raise NotEnough("answers", got, expected)
    return answers


def in_time(answers: DataFrame, latency: str, timeout: float) -> DataFrame:
    """The answers that came in time; the others are passed over."""
    return answers.where(F.col(latency) <= timeout)


Trainer = Callable[[DataFrame, DataFrame | None, int], DataFrame]
Evaluator = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class TaskResult:
    task: str
    status: str
    message: str | None
    weights: DataFrame | None
    history: list[tuple[int, float | None]]
    #: group, weights, size and fresh (trained since the last global average) of the aggregators.
    models: DataFrame | None = None


Listener = Callable[[str, int, Mapping[str, object]], None]


def run_task(
    task: str, algorithm: Algorithm, mapping: DataFrame, sizes: DataFrame, train: Trainer, evaluate: Evaluator, listeners: Sequence[Listener] = ()
) -> TaskResult:
    """All rounds: train, average at each aggregator, average globally, evaluate.

    Each aggregator keeps its average as its own weights until a global average takes their place.

    Each step is told to the listeners: its name, the round, and what there is to say.
    train(clients, weights, round) gives node, weights and round; rows of another round are stale and dropped.
    evaluate(clients, weights) gives node, value and size.
    The weights they are given are node and weights: those of each client's aggregator (no row where it has
    none yet), or None before there are any.
    """
    weights: DataFrame | None = None
    models: DataFrame | None = None
    history: list[tuple[int, float | None]] = []
    members = mapping.select("aggregator", F.col("client").alias("node"))
    clients = members.select("node")
    round_no = 0

    def own(some: DataFrame) -> DataFrame | None:
        """node and weights of some clients: those of their aggregators."""
        if models is None:
            return None
        of_groups = models.select(F.col("group").alias("aggregator"), "weights")
        return members.join(some.select("node"), "node", "left_semi").join(of_groups, "aggregator").select("node", "weights")

    def tell(step: str, **about: object) -> None:
        for listener in listeners:
            listener(step, round_no, about)

    try:
        while not algorithm.should_stop(round_no):
            tell("train")
            chosen = table(algorithm.select_train(members, sizes), "round-clients")
            answers = train(chosen, own(chosen), round_no).where(F.col("round") == round_no)
            updates = answers.join(sizes.select("node", F.col("value").alias("size")), "node").join(
                mapping.select(F.col("aggregator").alias("group"), F.col("client").alias("node")), "node"
            )
            local = table(algorithm.aggregate_train(table(updates, "round-updates")).select("group", "weights", "size"), "round-local")
            tell("local aggregation", weights=local)
            current = local.withColumn("fresh", F.lit(True))
            if models is not None:
                current = current.unionByName(models.join(local, "group", "left_anti"))
            if algorithm.should_aggregate_globally(round_no):
                # every aggregator's average takes part, also that of the node that averages
                weights = table(federated_average(current.where("fresh").drop("fresh"), "weights", "size"), "round-global")
                tell("global aggregation", weights=weights)
                groups = members.select(F.col("aggregator").alias("group")).distinct()
                current = groups.crossJoin(F.broadcast(weights.select("weights", "size"))).withColumn("fresh", F.lit(False))
            models = table(current, "round-models")
            judges = algorithm.select_eval(clients)
            scores = evaluate(judges, own(judges))
            history.append((round_no, algorithm.aggregate_eval(scores).first()["accuracy"]))
            tell("evaluation", accuracy=history[-1][1])
            round_no += 1
    except (NotEnough, MissingContext) as fault:
        return TaskResult(task, "Error", str(fault), weights, history, models)
    return TaskResult(task, "Ok", None, weights, history, models)
