from postledger.plans.rank import rank, rank_all
from postledger.plans.score import score
from postledger.plans.sync import sync, sync_bodies, sync_listed

__all__ = ["rank", "rank_all", "score", "sync", "sync_bodies", "sync_listed"]
