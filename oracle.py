"""DuckDB statements for the results of ``__spark_entry__.queries()``.

Written independently of the Spark operators: whole-tape windows and trade-level joins, where the
operators use slices, pre-aggregation and merged passes. One shared list of common table
expressions; DuckDB evaluates only those a statement refers to.
"""

from __future__ import annotations

STAGES = """
tape as (
  select *, json_extract_string(props, '$.k')::bigint % 20 as c, floor(epoch(ts) / 3600)::bigint as blk from events
),
raw_swaps as (
  select '0xSW_' || event_id as tx_hash, blk as block_number, ts as block_timestamp, '0xTOK_' || c as token_address,
         '0xCURVE_' || c as curve_address, '0xUSER_' || user_id as trader_address,
         if(event_type = 'error', 'sell', 'buy') as trade_type, value / 20 as base_asset_amount,
         value * 1000 * (1 + event_id % 7) as token_amount, value / 2000 as protocol_fee_amount,
         (10 + event_id % 200)::double as gas_price_gwei, event_id::bigint as tx_index
  from tape where event_type in ('purchase', 'click', 'error')
),
raw_launches as (
  select 'evt_' || event_id as event_id, '0xEV_' || event_id as tx_hash, blk as block_number, ts as block_timestamp,
         '0xTOK_' || c as token_address, '0xCURVE_' || c as curve_address, 'CurveCreated' as event_type,
         '0xUSER_' || user_id as creator_address, 5e5::double * pow(4, c % 5) as initial_token_supply,
         15000::double as virtual_base_reserves, 1.073e9::double as virtual_token_reserves,
         (25 + 20 * c)::double as graduation_threshold_base
  from tape qualify row_number() over (partition by c order by event_id) = 1
),
raw_events as (
  from raw_launches
  union all
  select 'fee_' || event_id, '0xEV_' || event_id, blk, ts, '0xTOK_' || c, '0xCURVE_' || c, 'FeeCollected',
         '0xUSER_' || user_id, null, null, null, null
  from tape where event_type = 'signup'
),
swaps as (
  select * replace (lower(token_address) as token_address, lower(curve_address) as curve_address,
                    lower(trader_address) as trader_address, upper(trade_type) as trade_type),
         base_asset_amount / token_amount as execution_price,
         if(upper(trade_type) = 'BUY', 1, -1) as side
  from raw_swaps where token_amount > 0 and base_asset_amount >= 0
),
launches as (
  select lower(token_address) as token_address, lower(curve_address) as curve_address,
         lower(creator_address) as creator_address, initial_token_supply, virtual_base_reserves,
         virtual_token_reserves, graduation_threshold_base, block_timestamp as creation_timestamp,
         block_number as creation_block
  from raw_launches
),
walk as (
  select *, sum(side * base_asset_amount) over seen as collected, sum(side * token_amount) over seen as sold
  from swaps
  window seen as (partition by curve_address order by block_number, tx_index, tx_hash rows unbounded preceding)
),
priced as (
  select w.*, l.creator_address, l.creation_timestamp, l.creation_block, l.initial_token_supply,
         l.graduation_threshold_base, l.virtual_base_reserves + collected as x, l.virtual_token_reserves - sold as y,
         (l.virtual_base_reserves + collected) / nullif(l.virtual_token_reserves - sold, 0) as spot,
         round(least(100, greatest(0, collected / nullif(l.graduation_threshold_base, 0) * 100)), 2) as fill
  from walk w join launches l using (curve_address)
),
state as (
  select *, lag(spot) over tape_order as spot_before, lag(fill) over tape_order as fill_before,
         if(fill >= 100, 'GRADUATED', 'ACTIVE') as curve_status
  from priced
  window tape_order as (partition by curve_address order by block_number, tx_index, tx_hash)
),
wallet_sums as (
  select token_address, curve_address, trader_address,
         min(block_timestamp) as first_ts, max(block_timestamp) as last_ts, min(block_number) as first_block,
         min(creation_block) as creation_block, count(*) filter (side = 1) as buys, count(*) filter (side = -1) as sells,
         coalesce(sum(base_asset_amount) filter (side = 1), 0) as invested,
         coalesce(sum(base_asset_amount) filter (side = -1), 0) as realized,
         sum(side * token_amount) as balance, max(gas_price_gwei) as gas_max, avg(gas_price_gwei) as gas_avg,
         any_value(creator_address) as creator_address
  from state group by all
),
wallets as (
  select *, first_block - creation_block as delta, (trader_address = creator_address)::integer as is_creator,
         (first_block - creation_block <= 2)::integer as is_sniper, (balance > 0 and sells = 0)::integer as is_accumulator,
         case when trader_address = creator_address then 'DEV_TEAM' when first_block - creation_block <= 2 then 'SNIPER'
              when invested >= 10 then 'WHALE' when least(buys, sells) >= 2 then 'SWING_TRADER'
              when least(buys, sells) >= 1 and balance <= 0 then 'PAPER_HANDS'
              when buys >= 1 and sells = 0 then 'DIAMOND_HANDS' else 'RETAIL_ORGANIC' end as cohort,
         round(realized - invested, 4) as pnl
  from wallet_sums
),
facts as (
  select s.*, w.cohort, w.is_sniper, w.is_creator
  from state s left join wallets w using (token_address, curve_address, trader_address)
),
velocity as (
  select *, round(total_token_supply * close_price, 4) as implied_market_cap_base,
         round(round(tokens / nullif(total_token_supply, 0) * 100, 9), 4) as turnover_rate_pct,
         if(total_token_supply * close_price > 0, round(volume / (total_token_supply * close_price), 4), 0) as v
  from (
    select token_address, curve_address, strftime(block_timestamp, '%Y-%m-%d') as trade_date,
           count(distinct tx_hash) as tx_count, count(distinct trader_address) as unique_active_traders,
           sum(base_asset_amount) as volume, sum(token_amount) as tokens, avg(spot) as avg_price,
           max(spot) as close_price, max(fill) as fill, max(curve_status) as curve_status,
           max(initial_token_supply) as total_token_supply,
           coalesce(sum(base_asset_amount) filter (cohort = 'SNIPER'), 0) as sniper_volume
    from facts group by all)
),
velocity_tiers as (
  select *, case when v >= 2 then 'HYPER_VELOCITY' when v >= 0.5 then 'HEALTHY_CIRCULATION'
                 when v >= 0.1 then 'MODERATE_VELOCITY' else 'STAGNANT_LIQUIDITY' end as velocity_health_tier
  from velocity
),
lifetimes as (
  select trader_address, count(distinct curve_address) as curves, count(distinct token_address) as tokens,
         min(first_ts) as first_ts, max(last_ts) as last_ts, sum(buys)::bigint as buys, sum(sells)::bigint as sells,
         sum(invested) as invested, sum(realized) as realized, sum(pnl) as pnl, max(is_sniper) as sniped,
         max(is_creator) as dev
  from wallets group by all
),
segments as (
  select *, case when dev = 1 then 'DEV_TEAM' when sniped = 1 then 'SNIPER' when invested >= 25 then 'WHALE'
                 when least(buys, sells) >= 5 then 'HIGH_FREQUENCY_TRADER'
                 when buys >= 1 and sells = 0 then 'ACCUMULATOR' else 'RETAIL_ORGANIC' end as segment
  from lifetimes
),
tokens as (
  select l.token_address, l.curve_address, l.creator_address, l.creation_timestamp, l.creation_block,
         l.initial_token_supply, l.graduation_threshold_base, count(distinct f.tx_hash) as total_trades,
         count(distinct f.trader_address) as total_unique_traders,
         round(round(coalesce(sum(f.base_asset_amount), 0), 9), 4) as lifetime_volume_base,
         round(round(coalesce(sum(f.protocol_fee_amount), 0), 9), 4) as lifetime_protocol_fees_base,
         round(round(coalesce(max(f.collected), 0), 9), 4) as current_base_in_curve, coalesce(max(f.fill), 0) as curve_fill_pct,
         coalesce(max(f.curve_status), 'ACTIVE') as curve_status, round(coalesce(max(f.spot), 0), 8) as all_time_high_price,
         count(distinct f.trader_address) filter (f.is_sniper = 1) as total_snipers_detected,
         coalesce(round(coalesce(sum(f.base_asset_amount) filter (f.is_sniper = 1), 0)
                        / nullif(sum(f.base_asset_amount), 0) * 100, 2), 0) as sniper_volume_penetration_pct
  from launches l left join facts f using (token_address, curve_address) group by all
),
log as (
  select tx_hash, block_number, block_timestamp as block_time, curve_address, token_address, trader_address,
         trade_type = 'buy' as is_buy, if(trade_type = 'buy', 1, -1) as side,
         (base_asset_amount * 1e18)::decimal(38, 0)::double / 1e18 as base_asset_amount,
         (token_amount * 1e18)::decimal(38, 0)::double / 1e18 as token_amount,
         (protocol_fee_amount * 1e18)::decimal(38, 0)::double / 1e18 as protocol_fee,
         (gas_price_gwei * 1e9)::decimal(38, 0)::double / 1e9 as gas_price_gwei
  from raw_swaps
),
log_curves as (
  select curve_address, token_address, creator_address, block_number as creation_block, block_timestamp as creation_time,
         (initial_token_supply * 1e18)::decimal(38, 0)::double / 1e18 as initial_token_supply,
         (virtual_base_reserves * 1e18)::decimal(38, 0)::double / 1e18 as virtual_base_reserves,
         (virtual_token_reserves * 1e18)::decimal(38, 0)::double / 1e18 as virtual_token_reserves,
         (graduation_threshold_base * 1e18)::decimal(38, 0)::double / 1e18 as graduation_threshold_base
  from raw_launches
),
monitor as (
  select l.token_address, l.curve_address, l.creator_address, l.creation_time, t.block_time as last_trade_time,
         date_sub('minute', l.creation_time, t.block_time) as curve_age_minutes,
         round((l.virtual_base_reserves + t.net) / nullif(l.virtual_token_reserves - t.net_tokens, 0), 8) as spot_price_base,
         round(t.net, 4) as total_base_locked, round(l.graduation_threshold_base, 4) as graduation_target_base,
         round(l.graduation_threshold_base - t.net, 4) as base_remaining_to_graduate,
         round(least(100, greatest(0, t.net / nullif(l.graduation_threshold_base, 0) * 100)), 2) as curve_fill_pct
  from (
    select *, sum(side * base_asset_amount) over seen as net, sum(side * token_amount) over seen as net_tokens
    from log
    window seen as (partition by curve_address order by block_time, tx_hash rows unbounded preceding)
    qualify row_number() over (partition by curve_address order by block_time desc, tx_hash desc) = 1
  ) t join log_curves l using (curve_address)
),
forensics as (
  select *, round(realized - invested, 4) as net_pnl_base, round(round(balance / nullif(supply, 0) * 100, 9), 4) as pct,
         case when trader_address = creator_address then 'DEV_TEAM_WALLET' when delta <= 1 then 'BLOCK_0_1_MEV_SNIPER'
              when delta <= 5 then 'EARLY_BOT_SNIPER' when balance / nullif(supply, 0) >= 0.02 then 'WHALE_HOLDER'
              when least(buys, sells) >= 2 then 'HIGH_FREQUENCY_TRADER'
              when buys >= 1 and sells = 0 then 'ORGANIC_ACCUMULATOR' else 'RETAIL_ORGANIC' end as wallet_cohort
  from (
    select curve_address, s.token_address, trader_address, any_value(creator_address) as creator_address,
           any_value(initial_token_supply) as supply, min(block_number) as first_block,
           any_value(creation_block) as creation_block, min(block_number) - any_value(creation_block) as delta,
           count(*) filter (is_buy) as buys, count(*) filter (not is_buy) as sells,
           coalesce(sum(base_asset_amount) filter (is_buy), 0) as invested,
           coalesce(sum(base_asset_amount) filter (not is_buy), 0) as realized,
           sum(side * token_amount) as balance, max(gas_price_gwei) as gas
    from log s join log_curves l using (curve_address) group by all)
),
holders as (
  select *, row_number() over (partition by curve_address order by balance desc, trader_address) as holder_rank,
         round(round(balance / sum(balance) over (partition by curve_address) * 100, 9), 4) as circulating_pct
  from forensics where balance > 0
),
early as (
  select l.token_address, l.curve_address, l.initial_token_supply, max(block_timestamp) as last_early_buy,
         coalesce(sum(s.token_amount), 0) as tokens_bought_early,
         round(round(coalesce(sum(s.token_amount), 0) / l.initial_token_supply * 100, 9), 4) as penetration_pct
  from (
    select distinct token_address, curve_address, initial_token_supply, creation_block + unnest([0, 1, 2]) as block
    from launches
  ) l left join swaps s on s.curve_address = l.curve_address and s.side = 1 and s.block_number = l.block
  group by l.token_address, l.curve_address, l.initial_token_supply
),
dev as (
  select *, sum(side * token_amount) over run as balance,
         sum(if(side = -1, token_amount, 0)) over run as dev_sold
  from state where trader_address = creator_address
  window run as (partition by curve_address order by block_number, tx_index, tx_hash rows unbounded preceding)
),
graduations as (
  select token_address, curve_address, creation_timestamp, min(block_timestamp) as graduated_at
  from state where fill >= 100 group by all
),
rollup as (
  select time_bucket(interval 5 minutes, block_timestamp) as window_start, round(sum(base_asset_amount), 4) as volume_base,
         round(sum(protocol_fee_amount), 6) as fees_base, count(*) as trades, count(distinct trader_address) as traders
  from swaps group by window_start
),
hours as (
  select block_number as hour, sum(protocol_fee_amount) as fees from swaps group by block_number
)
"""

_MONITOR_BANDS = """case when curve_fill_pct >= 100 then 'GRADUATED_TO_DEX'
  when curve_fill_pct >= 80 then 'HIGH_GRADUATION_VELOCITY' when curve_fill_pct >= 30 then 'ACCUMULATING'
  else 'EARLY_STAGE' end as lifecycle_status"""

_CONCENTRATION = """
select token_address, curve_address, count(distinct trader_address) as unique_holders,
       count(*) filter (wallet_cohort in ('BLOCK_0_1_MEV_SNIPER', 'EARLY_BOT_SNIPER')) as sniper_count,
       round(round(sum({pct}) filter (holder_rank <= 10), 9), 2) as top_10_supply_pct,
       round(round(sum({pct} * {pct}), 9), 2) as concentration_hhi,
       case when round(round(sum({pct} * {pct}), 9), 2) > 2500 then 'HIGH_CENTRALIZATION_RISK (WHALE / CABAL)'
            when round(round(sum({pct} * {pct}), 9), 2) > 1500 then 'MODERATE_CONCENTRATION'
            else 'HEALTHY_DECENTRALIZED_DISTRIBUTION' end as distribution_health
from holders group by all"""

SELECTS = {
    "stg_swaps": """
select * exclude (side) replace (round(execution_price, 12) as execution_price) from swaps""",
    "stg_curve_events": """
select * replace (lower(token_address) as token_address, lower(curve_address) as curve_address,
                  lower(creator_address) as creator_address) from raw_events""",
    "stg_transfers": """
select * from (
  select '0xTR_' || event_id as tx_hash, blk as block_number, ts as block_timestamp, lower('0xTOK_' || c) as token_address,
         lower('0xUSER_' || user_id) as from_address, lower('0xUSER_' || (event_id % 150)) as to_address,
         value * 1000 as amount
  from tape where event_type = 'view')
where amount > 0 and from_address <> to_address""",
    "decode_swaps": """
select tx_hash, block_number, block_time, curve_address, token_address, trader_address, is_buy,
       round(base_asset_amount, 8) as base_asset_amount, round(token_amount, 6) as token_amount,
       round(protocol_fee, 8) as protocol_fee, round(gas_price_gwei, 6) as gas_price_gwei from log""",
    "decode_curves": """
select curve_address, token_address, creator_address, creation_block, creation_time,
       round(initial_token_supply, 4) as initial_token_supply, round(virtual_base_reserves, 4) as virtual_base_reserves,
       round(virtual_token_reserves, 4) as virtual_token_reserves,
       round(graduation_threshold_base, 4) as graduation_threshold_base from log_curves""",
    "curve_meta": "select * from launches",
    "curve_state": """
select tx_hash, block_number, block_timestamp, token_address, curve_address, creator_address, creation_timestamp,
       creation_block, trader_address, trade_type, base_asset_amount, token_amount, protocol_fee_amount, gas_price_gwei,
       tx_index, round(execution_price, 12) as execution_price, round(spot_before, 12) as spot_price_before_trade,
       round(spot, 12) as spot_price_after_trade,
       if(spot_before > 0, round(abs(execution_price - spot_before) / spot_before * 100, 4), 0) as slippage_pct,
       round(collected, 4) as cumulative_base_collected, graduation_threshold_base, fill as curve_fill_pct, curve_status
from state""",
    "curve_reserves": """
select tx_hash, curve_address, block_number, tx_index, round(x, 4) as base_reserve, round(y, 4) as token_reserve,
       round(x * y / 1e12, 6) as invariant_k_e12, round(spot, 12) as spot_price_after_trade from state""",
    "curve_monitor": f"select *, {_MONITOR_BANDS} from monitor",
    "graduation_radar": """
select token_address, curve_address, curve_fill_pct, total_base_locked, base_remaining_to_graduate, last_trade_time
from monitor where curve_fill_pct >= 80 and curve_fill_pct < 100""",
    "depth_matrix": """
select token_address, curve_address, d::double as order_base, round(x, 4) as base_reserve, round(y, 4) as token_reserve,
       round(y * d / (x + d), 4) as tokens_out, round((x + d) / y, 12) as average_price,
       round(d / x * 100, 4) as slippage_pct
from (from state qualify row_number() over (partition by curve_address
        order by block_number desc, tx_index desc, tx_hash desc) = 1),
     (values (0.5::double), (2), (10)) sizes(d)""",
    "graduation_eta": """
select token_address, curve_address, minute as minute_start, round(collected, 4) as base_collected,
       round(remaining, 4) as base_remaining, round(inflow / 15, 6) as inflow_per_minute,
       round(case when remaining <= 0 then 0 when inflow > 0 then remaining / (inflow / 15) end, 6)
         as est_minutes_to_graduate
from (
  select * replace (round(inflow, 9) as inflow), round(graduation_threshold_base - collected, 9) as remaining
  from (
  select curve_address, minute,
         sum(net) over (partition by curve_address order by minute rows unbounded preceding) as collected,
         sum(net) over (partition by curve_address order by minute
                        range between interval 14 minutes preceding and current row) as inflow
  from (select curve_address, date_trunc('minute', block_timestamp) as minute, sum(side * base_asset_amount) as net
        from swaps group by all)
  ) join launches using (curve_address))""",
    "inflow_15m": """
select curve_address, date_trunc('minute', block_timestamp) - to_minutes(k) as window_start,
       round(sum(side * base_asset_amount), 4) as net_inflow_base, round(sum(base_asset_amount), 4) as volume_base,
       count(*) as trades
from swaps, (select unnest(range(15))::integer as k) group by all""",
    "fill_leaderboard": """
select token_address, curve_address, now_pct as curve_fill_pct, fill_gain_pct,
       round(fill_gain_pct / 1440, 6) as fill_pct_per_minute,
       row_number() over (order by fill_gain_pct desc, curve_address)::integer as position
from (
  select token_address, curve_address,
         round(least(100, greatest(0, net / graduation_threshold_base * 100)), 2) as now_pct,
         round(now_pct - round(least(100, greatest(0, (net - gained) / graduation_threshold_base * 100)), 2), 2)
           as fill_gain_pct
  from (
    select curve_address, sum(side * base_asset_amount) as net,
           coalesce(sum(side * base_asset_amount) filter (
             block_timestamp > (select max(block_timestamp) from swaps) - interval 1440 minutes), 0) as gained
    from swaps group by all) join launches using (curve_address))""",
    "time_to_graduation": """
select *, date_sub('minute', creation_timestamp, graduated_at) as minutes_to_graduate from graduations""",
    "wallet_clusters": """
select token_address, curve_address, trader_address, first_ts as first_trade_timestamp, last_ts as last_trade_timestamp,
       first_block as first_trade_block, creation_block as curve_creation_block, delta as blocks_since_curve_creation,
       buys as buy_count, sells as sell_count, round(invested, 4) as total_base_invested,
       round(realized, 4) as total_base_realized, round(balance, 4) as current_token_balance, gas_max as max_gas_gwei,
       round(gas_avg, 4) as avg_gas_gwei, creator_address, is_creator, is_sniper, is_accumulator,
       cohort as behavioral_cohort, pnl as net_realized_pnl_base
from wallets""",
    "wallet_forensics": """
select curve_address, token_address, trader_address, creator_address, round(supply, 4) as total_supply,
       first_block as first_block_traded, creation_block, delta as sniper_block_delta, buys as buy_tx_count,
       sells as sell_tx_count, round(invested, 4) as total_base_invested, round(realized, 4) as total_base_realized,
       round(balance, 4) as current_token_balance, round(gas, 4) as peak_gas_gwei, net_pnl_base,
       pct as pct_supply_held, wallet_cohort
from forensics""",
    "holder_rank": """
select curve_address, token_address, trader_address, holder_rank::integer as holder_rank,
       round(balance, 4) as current_token_balance, pct as pct_supply_held, wallet_cohort
from holders""",
    "supply_concentration": _CONCENTRATION.format(pct="pct"),
    "supply_concentration_circulating": _CONCENTRATION.format(pct="circulating_pct"),
    "sniper_penetration": """
select *, case when penetration_pct > 40 then 'EMERGENCY' when penetration_pct > 25 then 'ORANGE' else 'NORMAL' end
  as risk_tag from early""",
    "dev_activity": """
select tx_hash, block_number, block_timestamp, tx_index, token_address, curve_address, creator_address, trade_type,
       token_amount, fill as curve_fill_pct, round(balance, 4) as creator_balance,
       round(dev_sold, 4) as creator_tokens_sold,
       round(dev_sold - if(side = -1, token_amount, 0), 4) as creator_sold_before
from dev""",
    "dump_risk": """
select *, if(tokens_sold_early > 0.1 * initial_allocation, 'High Dump Risk', 'NONE') as risk_flag
from (
  select token_address, curve_address, creator_address,
         round(coalesce(sum(token_amount) filter (side = 1 and dev_sold = 0), 0), 4) as initial_allocation,
         round(coalesce(sum(token_amount) filter (side = -1), 0), 4) as tokens_sold,
         round(coalesce(sum(token_amount) filter (side = -1 and fill < 80), 0), 4) as tokens_sold_early
  from dev group by all)""",
    "token_velocity": """
select token_address, curve_address, trade_date, tx_count, unique_active_traders, round(volume, 4) as daily_volume_base,
       round(tokens, 4) as daily_tokens_traded, round(avg_price, 12) as avg_daily_price,
       round(close_price, 12) as close_price, fill as end_of_day_curve_fill_pct, curve_status, total_token_supply,
       implied_market_cap_base, turnover_rate_pct, v as token_velocity_index, velocity_health_tier
from velocity_tiers""",
    "velocity_profile": """
select trade_date, token_address, curve_address, tx_count, active_traders_count, round(volume, 4) as volume_base,
       round(cap, 4) as market_cap_base, round(round(tokens / nullif(supply, 0) * 100, 9), 4) as turnover_pct, v as token_velocity,
       case when v > 2 then 'HYPER_VELOCITY (HIGH SPECULATION / BOT CHURN)' when v >= 0.5 then 'ORGANIC_LIQUID_VELOCITY'
            when v >= 0.1 then 'LOW_VELOCITY (ACCUMULATION PHASE)' else 'STAGNANT (LIQUIDITY RISK)' end as velocity_profile
from (
  select *, supply * price as cap, if(supply * price > 0, round(volume / (supply * price), 4), 0) as v
  from (
    select date_trunc('day', block_time)::timestamp as trade_date, s.token_address, curve_address,
           count(distinct tx_hash) as tx_count, count(distinct trader_address) as active_traders_count,
           sum(base_asset_amount) as volume, sum(token_amount) as tokens,
           avg(base_asset_amount / nullif(token_amount, 0)) as price, any_value(initial_token_supply) as supply
    from log s join log_curves l using (curve_address) group by all))""",
    "velocity_24h": """
select token_address, curve_address, hour as hour_start, round(volume_24h, 4) as volume_24h,
       round(circ, 4) as circulating_supply, round(px, 12) as spot_price, round(circ * px, 4) as circulating_market_cap,
       if(circ * px > 0, round(volume_24h / (circ * px), 4), 0) as velocity_24h
from (
  select *, (virtual_base_reserves + net) / nullif(virtual_token_reserves - circ, 0) as px
  from (
    select curve_address, hour,
           sum(volume) over (partition by curve_address order by hour
             range between interval 23 hours preceding and current row) as volume_24h,
           sum(hour_base) over so_far as net, sum(hour_tokens) over so_far as circ
    from (select curve_address, date_trunc('hour', block_timestamp) as hour, sum(base_asset_amount) as volume,
                 sum(side * base_asset_amount) as hour_base, sum(side * token_amount) as hour_tokens
          from swaps group by all)
    window so_far as (partition by curve_address order by hour rows unbounded preceding)
  ) join launches using (curve_address))""",
    "retention": """
select token_address, strftime(cohort, '%Y-%m-%d') as cohort_day, count(*) as buyers,
       sum(d1)::bigint as d1_retained, sum(d3)::bigint as d3_retained, sum(d7)::bigint as d7_retained,
       round(sum(d1) / count(*) * 100, 2) as d1_retention_pct, round(sum(d3) / count(*) * 100, 2) as d3_retention_pct,
       round(sum(d7) / count(*) * 100, 2) as d7_retention_pct
from (
  select token_address, trader_address, cohort, bool_or(block_timestamp::date = cohort + 1)::integer as d1,
         bool_or(block_timestamp::date = cohort + 3)::integer as d3,
         bool_or(block_timestamp::date = cohort + 7)::integer as d7
  from swaps join (
    select token_address, trader_address, min(block_timestamp)::date as cohort from swaps where side = 1 group by all
  ) using (token_address, trader_address) group by all)
group by all""",
    "fct_trades": """
select tx_hash, block_number, block_timestamp, token_address, curve_address, trader_address, cohort as trader_cohort,
       is_sniper, is_creator, trade_type, base_asset_amount, token_amount, protocol_fee_amount, gas_price_gwei, tx_index,
       round(execution_price, 12) as execution_price, round(spot, 12) as spot_price_after_trade,
       if(spot_before > 0, round(abs(execution_price - spot_before) / spot_before * 100, 4), 0) as slippage_pct,
       round(collected, 4) as cumulative_base_collected, fill as curve_fill_pct, curve_status
from facts""",
    "fct_curve_daily": """
select token_address, curve_address, trade_date, tx_count, unique_active_traders, round(volume, 4) as daily_volume_base,
       round(sniper_volume, 4) as sniper_volume_base,
       if(volume > 0, round(sniper_volume / volume * 100, 2), 0) as sniper_volume_share_pct,
       round(tokens, 4) as daily_tokens_traded, round(avg_price, 12) as avg_daily_price,
       round(close_price, 12) as close_price, implied_market_cap_base, fill as end_of_day_curve_fill_pct,
       v as token_velocity_index, turnover_rate_pct, velocity_health_tier, curve_status
from velocity_tiers""",
    "dim_wallets": """
select trader_address, curves as unique_curves_traded, tokens as unique_tokens_traded,
       first_ts as wallet_first_active_time, last_ts as wallet_last_active_time, buys as lifetime_buy_count,
       sells as lifetime_sell_count, round(invested, 4) as lifetime_base_invested,
       round(realized, 4) as lifetime_base_realized, round(pnl, 4) as lifetime_net_pnl_base, sniped as ever_sniped,
       dev as is_protocol_or_dev, segment as primary_wallet_segment,
       case sign(pnl) when 1 then 'PROFITABLE' when -1 then 'UNPROFITABLE' else 'BREAKEVEN' end as profitability_status
from segments""",
    "dim_tokens": "select * from tokens",
    "dash_active_curves": """
select token_address, curve_fill_pct, current_base_in_curve, graduation_threshold_base, curve_status,
       sniper_volume_penetration_pct, total_snipers_detected from tokens""",
    "dash_daily_velocity": """
select trade_date, token_address, round(volume, 4) as daily_volume_base, v as token_velocity_index, turnover_rate_pct,
       velocity_health_tier from velocity_tiers""",
    "dash_wallet_segments": """
select segment as primary_wallet_segment, count(*) as total_wallets, round(sum(round(invested, 4)), 2) as total_volume_base,
       round(avg(round(pnl, 4)), 2) as avg_pnl_base from segments group by all""",
    "kpi_summary": """
select count(*) as monitored_launches, round(sum(current_base_in_curve), 4) as total_base_locked,
       (select count(*) from segments) as tracked_wallets,
       (select round(avg(v), 6) from velocity) as avg_token_velocity_index
from tokens""",
    "protocol_kpis": """
select count(*) as created_curves, count(*) filter (graduated_at is null) as active_curves,
       count(*) filter (l.creation_timestamp::date = last.ts::date) as created_today,
       count(graduated_at) as graduated_curves, round(count(graduated_at) / count(*) * 100, 2) as graduation_rate_pct,
       round(avg(date_sub('minute', l.creation_timestamp, graduated_at)), 4) as avg_minutes_to_graduate,
       any_value(round(fees, 6)) as fees_24h, any_value(round(volume, 4)) as volume_24h, any_value(traders) as traders_24h
from launches l left join graduations using (token_address, curve_address),
     (select max(block_timestamp) as ts from swaps) last,
     (select sum(protocol_fee_amount) as fees, sum(base_asset_amount) as volume,
             count(distinct trader_address) as traders
      from swaps where block_timestamp > (select max(block_timestamp) from swaps) - interval 24 hours)""",
    "organic_bot_share": """
select round(total, 4) as total_volume_base, round(organic, 4) as organic_volume_base, round(bot, 4) as bot_volume_base,
       round(organic / total * 100, 4) as organic_share_pct, round(bot / total * 100, 4) as bot_share_pct,
       round(organic / nullif(bot, 0), 4) as organic_to_bot_ratio
from (
  select sum(base_asset_amount) as total,
         coalesce(sum(base_asset_amount) filter (segment in ('RETAIL_ORGANIC', 'ACCUMULATOR')), 0) as organic,
         coalesce(sum(base_asset_amount) filter (segment in ('SNIPER', 'HIGH_FREQUENCY_TRADER')), 0) as bot
  from state join segments using (trader_address))""",
    "rollup_5m": "from rollup",
    "alerts": """
select 'WHALE_INFLOW' as alert_type, 'Medium' as severity, token_address, curve_address, block_timestamp as event_ts,
       tx_hash, round(base_asset_amount, 6) as metric_value, round(remaining * 0.15, 6) as threshold
from (select *, round(graduation_threshold_base - (collected - base_asset_amount), 9) as remaining
      from state where side = 1)
where remaining > 0 and base_asset_amount > remaining * 0.15
union all
select 'IMMINENT_GRADUATION', 'Info', token_address, curve_address, block_timestamp, tx_hash, fill, 90
from (from state where fill >= 90 and coalesce(fill_before, 0) < 90
      qualify row_number() over (partition by curve_address order by block_number, tx_index, tx_hash) = 1)
union all
select 'DEV_DUMPING', 'Critical', token_address, curve_address, block_timestamp, tx_hash,
       round(dev_sold / initial_token_supply * 100, 6), 5
from dev
where side = -1 and fill < 100 and dev_sold > initial_token_supply * 5.0 / 100
  and dev_sold - token_amount <= initial_token_supply * 5.0 / 100
union all
select 'SNIPER_HIJACK', 'High', token_address, curve_address, last_early_buy, null, penetration_pct, 35
from early where penetration_pct > 35""",
    "fee_spike": """
select make_timestamp(hour * 3600000000) as hour_start, round(fees, 6) as hourly_fees, round(mean, 10) as trailing_mean,
       hour - min(hour) over () >= 168 and fees > 3 * mean as is_spike
from (select hour, fees, coalesce(sum(fees) over (order by hour range between 168 preceding and 1 preceding), 0) / 168 as mean
      from hours)""",
    "check_graduation": """
select 'graduation' as check_name, count(*) as rows_tested,
       count(*) filter ((curve_fill_pct >= 100) <> (curve_status = 'GRADUATED') or curve_fill_pct not between 0 and 100)
         as violations from tokens""",
    "check_snipers": """
select 'snipers' as check_name, count(*) as rows_tested,
       count(*) filter (is_sniper <> 1 or cohort not in ('SNIPER', 'DEV_TEAM')) as violations
from wallets where delta <= 2""",
    "check_whales": """
select 'whales' as check_name, count(*) as rows_tested, count(*) filter (segment <> 'WHALE') as violations
from segments where invested >= 25 and dev = 0 and sniped = 0""",
    "check_velocity": """
select 'velocity' as check_name, count(*) as rows_tested,
       count(*) filter (v is null or turnover_rate_pct is null or v < 0 or turnover_rate_pct < 0) as violations
from velocity""",
    "check_wallet_grain": """
select 'wallet_grain' as check_name, count(distinct s.trader_address) as rows_tested,
       abs(count(distinct s.trader_address) - (select count(*) from segments)) as violations
from swaps s semi join launches using (curve_address)""",
    "check_grain": """
select 'grain_raw_swaps' as check_name, count(*) as rows_tested, count(*) - count(distinct tx_hash) as violations from raw_swaps
union all select 'grain_raw_curve_events', count(*), count(*) - count(distinct event_id) from raw_events
union all select 'grain_fct_trades', count(*), count(*) - count(distinct tx_hash) from facts
union all select 'grain_fct_curve_daily', count(*), count(*) - count(distinct (curve_address, trade_date)) from velocity
union all select 'grain_dim_wallets', count(*), count(*) - count(distinct trader_address) from segments
union all select 'grain_dim_tokens', count(*), count(*) - count(distinct token_address) from tokens""",
    "rollup_5m_stream": "from rollup",
    "curve_state_stream": "",
}
SELECTS["curve_state_stream"] = SELECTS["curve_state"]
SELECTS["marts_read_back"] = SELECTS["fct_trades"]
SELECTS["inflow_15m_stream"] = SELECTS["inflow_15m"]
SELECTS["alerts_stream"] = SELECTS["alerts"] + f"""
union all
select 'FEE_SPIKE', 'Info', null, null, hour_start, null, hourly_fees, round(trailing_mean * 3, 6)
from ({SELECTS["fee_spike"].strip()}) where is_spike"""
for _mart in ("fct_trades", "fct_curve_daily", "dim_wallets", "dim_tokens"):
    SELECTS[f"{_mart}_stream"] = SELECTS[_mart]


def statements() -> dict[str, str]:
    return {name: f"with {STAGES.strip()}\n{select.strip()}" for name, select in SELECTS.items()}
